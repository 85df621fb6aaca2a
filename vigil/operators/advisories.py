"""Dependencies against advisories and licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .trees import rollup

from ..functions import versions as V


def matches(dependencies: DataFrame, advisories: DataFrame, first_only: bool = True) -> DataFrame:
    """Vulnerable dependencies (ecosystem, name, version) with their advisory (ecosystem, package, ordinal, versions, ...).

    ``versions`` is an array of conjunctions, any of which may hold. An equi-join on (ecosystem, lower(name)), then the
    range check as an expression. first_only keeps the first advisory per dependency, in the order of ``ordinal``.
    """
    a = advisories.withColumn("_p", F.lower("package")).withColumnRenamed("ecosystem", "_e")
    j = dependencies.join(a, (F.col("ecosystem") == F.col("_e")) & (F.lower("name") == F.col("_p"))).drop("_e", "_p")
    j = j.where(F.coalesce(V.satisfies_any(F.col("version"), F.col("versions")), F.lit(False)))
    if not first_only:
        return j
    w = Window.partitionBy("ecosystem", "name", "version").orderBy("ordinal")
    return j.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def license_risk(dependencies: DataFrame, licenses: DataFrame) -> DataFrame:
    """Findings for risky or unknown licences: dependencies (name, license), licenses (license, risk)."""
    j = dependencies.join(licenses, "license", "left")
    kind: Column = F.when(F.col("risk").isin("high", "medium"), "risk").when(F.col("risk").isNull(), "unknown")
    return j.select("name", "license", kind.alias("finding"), F.coalesce("risk", F.lit("medium")).alias("severity")).where("finding is not null")


def transitive_summary(tree: DataFrame) -> DataFrame:
    """Counts of a dependency tree (name, version, depth, is_direct)."""
    return tree.agg(F.count("*").alias("total"), F.count_if("is_direct").alias("direct"), F.count_if(~F.col("is_direct")).alias("transitive"), F.countDistinct("name").alias("packages"), F.max("depth").alias("max_depth"))


def dependency_paths(tree: DataFrame) -> DataFrame:
    """(name, path): from the root to each package by the name of its parent, of several the first by name; by pointer
    doubling, so the tree may be of any depth. Packages on or under a cycle have none."""
    t = tree.select(F.lit("").alias("path"), "name", "parent")
    none = t.select("path", "name", F.lit("").alias("severity")).limit(0)
    return rollup(t, none).where("way is not null").select("name", F.array_join("way", " > ").alias("path"))


def enrich(tree: DataFrame, found: DataFrame) -> DataFrame:
    """Findings (path, name, severity, and more) with is_direct_dependency, dependency_depth, dependency_path, introduced_by and
    brought_by (the direct dependency that leads there); one that the tree does not hold counts as direct."""
    at = rollup(tree, found).select("path", "name", F.col("depth").alias("_d"), F.col("way").alias("_w"), F.col("root").alias("_r"))
    j = found.join(at, ["path", "name"], "left")
    return j.select(
        *found.columns, F.coalesce(F.col("_d") == 0, F.col("_w").isNull()).alias("is_direct_dependency"), F.coalesce("_d", F.lit(0)).alias("dependency_depth"), F.coalesce("_w", F.array("name")).alias("dependency_path"),
        F.when(F.col("_d") > 0, F.element_at("_w", -2)).alias("introduced_by"), F.coalesce("_r", "name").alias("brought_by"),
    )
