"""Threat intelligence: CSV with header aliases, STIX bundles, indicator feeds and control lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.secrets import ioc_type

# Accepted headers per field, and the values that the enumerations allow.
ALIASES = {"title": ("title", "name", "threat", "threat_name"), "description": ("description", "desc", "details", "summary"), "severity": ("severity", "risk", "priority", "level"), "type": ("type", "intel_type", "category"), "mitre": ("mitre", "mitre_techniques", "techniques", "ttp"), "tags": ("tags", "labels", "keywords")}
SEVERITIES = ("critical", "high", "medium", "low")
STRIDE = ("spoofing", "tampering", "repudiation", "information disclosure", "denial of service", "elevation of privilege")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return normalise(raw)


def normalise(raw: DataFrame) -> DataFrame:
    """Aliased headers become fields, lists split at ';', severities outside the list become medium; no title, no row."""
    have = {c.strip().lower().replace(" ", "_"): c for c in raw.columns}
    cols = {}
    for field, names in ALIASES.items():
        found = [F.nullif(F.trim(F.col(f"`{have[n]}`").cast("string")), F.lit("")) for n in names if n in have]
        cols[field] = F.coalesce(*found) if found else F.lit(None).cast("string")
    sev = F.lower(cols["severity"])
    listed = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    return raw.select(cols["title"].alias("title"), cols["description"].alias("description"), F.when(sev.isin(*SEVERITIES), sev).otherwise("medium").alias("severity"), cols["type"].alias("type"), listed(cols["mitre"]).alias("mitre"), listed(cols["tags"]).alias("tags")).where("title is not null")


STIX = "objects array<struct<type:string,id:string,name:string,description:string,pattern:string,confidence:int,external_references:array<struct<source_name:string,external_id:string>>,created:string>>"


def stix(bundles: DataFrame) -> DataFrame:
    """Objects of STIX 2.1 bundles (a column ``content``): kind, severity from confidence, MITRE ids."""
    o = bundles.select(F.explode(F.from_json("content", STIX)["objects"]).alias("o")).select("o.*")
    kind = F.when(F.col("type").isin("malware", "tool"), "malware").when(F.col("type") == "attack-pattern", "technique").when(F.col("type").isin("threat-actor", "intrusion-set", "campaign"), "actor").when(F.col("type") == "vulnerability", "vulnerability").when(F.col("type") == "indicator", "indicator")
    sev = F.when(F.col("confidence") >= 85, "critical").when(F.col("confidence") >= 65, "high").when(F.col("confidence") >= 35, "medium").when(F.col("confidence").isNotNull(), "low").otherwise("medium")
    refs = F.array_distinct(F.transform(F.filter(F.coalesce("external_references", F.array()), lambda r: r["source_name"].startswith("mitre")), lambda r: r["external_id"]))
    return o.select("id", kind.alias("kind"), "name", "description", sev.alias("severity"), refs.alias("mitre"), "pattern").where("kind is not null")


def indicators(stix_objects: DataFrame) -> DataFrame:
    """Values inside STIX patterns with their kind."""
    values = F.regexp_extract_all("pattern", F.lit(r"=\s*'([^']+)'"), F.lit(1))
    return stix_objects.where("pattern is not null").select("id", "severity", F.explode(values).alias("ioc_value")).withColumn("ioc_type", ioc_type(F.col("ioc_value")))


def controls(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad): effectiveness clamped to 0..1 (0.7 if none), STRIDE lists checked; bad rows with their reasons."""
    eff = F.expr("try_cast(effectiveness AS double)")
    cats = F.filter(F.transform(F.split(F.lower(F.coalesce("stride", F.lit(""))), ";"), lambda x: F.trim(x)), lambda x: x != "")
    df = raw.withColumn("_e", eff).withColumn("_c", cats)
    reason = F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "no name").when(F.col("effectiveness").isNotNull() & (F.trim("effectiveness") != "") & F.col("_e").isNull(), "effectiveness is no number").when(~F.forall("_c", lambda x: x.isin(*STRIDE)), "unknown category")
    df = df.withColumn("reason", reason)
    good = df.where("reason is null").select("name", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("_e", F.lit(0.7)))).alias("effectiveness"), F.col("_c").alias("stride"))
    return good, df.where("reason is not null").select("name", "reason")


def merge_by_cve(sources: list[DataFrame]) -> DataFrame:
    """Feeds (cve, source, exploited, cvss, description) in order of precedence merged per CVE; rows without one stay."""
    tagged = reduce(DataFrame.unionByName, [s.withColumn("_o", F.lit(i)) for i, s in enumerate(sources)])
    merged = tagged.where("cve is not null").groupBy("cve").agg(
        F.bool_or("exploited").alias("exploited"), F.min_by("cvss", F.when(F.col("cvss").isNotNull(), F.col("_o"))).alias("cvss"),
        F.max_by("description", F.struct(F.length("description"), -F.col("_o"))).alias("description"), F.sort_array(F.collect_set("source")).alias("sources"),
    )
    rest = tagged.where("cve is null").select("cve", "exploited", "cvss", "description", F.array("source").alias("sources"))
    return merged.unionByName(rest)
