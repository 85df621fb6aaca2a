"""Snapshots of vulnerability feeds, brought to one schema and merged: exploited-vulnerability catalogs, OSV, GitHub, NVD.

Files are read by Spark with fixed schemas (one JSON document per file); fields that a file lacks are null. Nothing is
fetched: a snapshot is a folder of files that a job outside put there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("source", "id", "cve", "ecosystem", "package", "severity", "cvss", "cwes", "fixed", "summary")

_KEV = "vulnerabilities array<struct<cveID:string,vendorProject:string,product:string,vulnerabilityName:string,dateAdded:string,shortDescription:string,requiredAction:string,knownRansomwareCampaignUse:string>>"
_OSV = (
    "id string, summary string, details string, aliases array<string>, severity array<struct<type:string,score:string>>, database_specific struct<severity:string,cwe_ids:array<string>,cvss:double>, "
    "affected array<struct<package:struct<name:string,ecosystem:string>,ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string>>>>>>"
)
_GITHUB = (
    "ghsa_id string, cve_id string, summary string, severity string, cvss struct<score:double>, cwes array<struct<cwe_id:string>>, "
    "vulnerabilities array<struct<package:struct<ecosystem:string,name:string>,vulnerable_version_range:string,first_patched_version:string>>"
)
_NVD = (
    "vulnerabilities array<struct<cve:struct<id:string,descriptions:array<struct<lang:string,value:string>>,metrics:struct<cvssMetricV31:array<struct<cvssData:struct<baseScore:double>>>,"
    "cvssMetricV2:array<struct<cvssData:struct<baseScore:double>>>>,weaknesses:array<struct<description:array<struct<lang:string,value:string>>>>>>>"
)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An uploaded JSON array (or one object) as rows."""
    return spark.read.schema(schema).json(path, multiLine=True)


def cvss_severity(score: Column) -> Column:
    return F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").when(score > 0, "low")


def first_cve(ids: Column) -> Column:
    return F.try_element_at(F.filter(ids, lambda x: x.startswith("CVE-")), F.lit(1))


def exploited(spark: SparkSession, path: str) -> DataFrame:
    """The catalog of exploited vulnerabilities as threats: (cve, vendor, product, name, added, summary, action, ransomware, exploited)."""
    v = json_array(spark, path, _KEV).select(F.explode("vulnerabilities").alias("v"))
    ransom = F.coalesce(F.lower("v.knownRansomwareCampaignUse") == "known", F.lit(False))
    return v.select(
        F.col("v.cveID").alias("cve"), F.col("v.vendorProject").alias("vendor"), F.col("v.product").alias("product"), F.col("v.vulnerabilityName").alias("name"),
        F.to_date("v.dateAdded").alias("added"), F.col("v.shortDescription").alias("summary"), F.col("v.requiredAction").alias("action"), ransom.alias("ransomware"), F.lit(True).alias("exploited"),
    )


def osv(spark: SparkSession, path: str) -> DataFrame:
    """One row per affected package, with the versions that fix it."""
    d = json_array(spark, path, _OSV).withColumn("a", F.explode("affected"))
    fixes = F.flatten(F.transform(F.coalesce("a.ranges", F.array()), lambda r: F.transform(F.coalesce(r.events, F.array()), lambda e: e.fixed)))
    score = F.coalesce("database_specific.cvss", F.try_element_at(F.filter(F.transform("severity", lambda s: s.score.try_cast("double")), lambda x: x.isNotNull()), F.lit(1)))
    named = F.lower("database_specific.severity")
    level = F.coalesce(F.when(named == "moderate", "medium").otherwise(named), cvss_severity(score), F.lit("medium"))
    return d.select(
        F.lit("osv").alias("source"), "id", F.coalesce(first_cve(F.col("aliases")), F.when(F.col("id").startswith("CVE-"), F.col("id"))).alias("cve"), F.lower("a.package.ecosystem").alias("ecosystem"), F.lower("a.package.name").alias("package"),
        level.alias("severity"), score.alias("cvss"), F.coalesce("database_specific.cwe_ids", F.array().cast("array<string>")).alias("cwes"), F.array_distinct(F.filter(fixes, lambda x: x.isNotNull())).alias("fixed"), F.coalesce("summary", "details").alias("summary"),
    )


def github(spark: SparkSession, path: str) -> DataFrame:
    d = json_array(spark, path, _GITHUB).withColumn("a", F.explode("vulnerabilities"))
    level = F.lower("severity")
    return d.select(
        F.lit("github").alias("source"), F.col("ghsa_id").alias("id"), F.col("cve_id").alias("cve"), F.lower("a.package.ecosystem").alias("ecosystem"), F.lower("a.package.name").alias("package"),
        F.coalesce(F.when(level == "moderate", "medium").otherwise(level), cvss_severity(F.col("cvss.score")), F.lit("medium")).alias("severity"), F.col("cvss.score").alias("cvss"),
        F.coalesce(F.transform("cwes", lambda c: c.cwe_id), F.array().cast("array<string>")).alias("cwes"), F.array_compact(F.array("a.first_patched_version")).alias("fixed"), "summary",
    )


def nvd(spark: SparkSession, path: str, ecosystem: str | None = None, package: str | None = None) -> DataFrame:
    """The answer to a keyword search: what it was asked for is the package."""
    v = json_array(spark, path, _NVD).select(F.explode("vulnerabilities").alias("v")).select("v.cve.*")
    score = F.coalesce(F.try_element_at("metrics.cvssMetricV31", F.lit(1)).cvssData.baseScore, F.try_element_at("metrics.cvssMetricV2", F.lit(1)).cvssData.baseScore)
    english = F.try_element_at(F.filter("descriptions", lambda d: d.lang == "en"), F.lit(1)).value
    weak = F.flatten(F.transform(F.coalesce("weaknesses", F.array()), lambda w: F.transform(w.description, lambda d: d.value)))
    return v.select(
        F.lit("nvd").alias("source"), "id", F.col("id").alias("cve"), F.lit(ecosystem).cast("string").alias("ecosystem"), F.lit(package).cast("string").alias("package"), F.coalesce(cvss_severity(score), F.lit("medium")).alias("severity"),
        score.alias("cvss"), F.array_distinct(F.filter(weak, lambda x: x.startswith("CWE-"))).alias("cwes"), F.array().cast("array<string>").alias("fixed"), english.alias("summary"),
    )


def merge(feeds: list[DataFrame]) -> DataFrame:
    """The union of normalised feeds; of rows with one package and CVE (else package, source and id) the first feed's stays."""
    tagged = [f.select(*COLUMNS, F.lit(i).alias("_order")) for i, f in enumerate(feeds)]
    name = F.coalesce("package", F.lit(""))
    key = F.when(F.col("cve").isNotNull(), F.concat_ws(":", name, "cve")).otherwise(F.concat_ws(":", name, "source", "id"))
    row = F.struct(*COLUMNS)
    return reduce(DataFrame.union, tagged).groupBy(key.alias("_key")).agg(F.min_by(row, F.struct("_order", "id")).alias("r")).select("r.*")


def against_cache(asked: DataFrame, cache: DataFrame, keys: list[str], max_age_hours: int = 6) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of ``asked``: cache rows have ``keys`` and fetched_at; entries older than the limit do not count."""
    fresh = cache.where(F.col("fetched_at") >= F.current_timestamp() - F.make_interval(hours=F.lit(max_age_hours)))
    return asked.join(fresh, keys), asked.join(fresh.select(*keys).distinct(), keys, "left_anti")
