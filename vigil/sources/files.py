"""Source trees, tables and simple sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extension -> language, folders that are not scanned, the largest file that is.
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go", "rb": "ruby", "php": "php", "cs": "csharp", "c": "c", "cpp": "cpp", "rs": "rust", "kt": "kotlin", "swift": "swift"}
SKIPPED = ("node_modules", "venv", ".git", "__pycache__", "dist", "build")
MAX_BYTES = 1 << 20


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.when(F.lit(False), "")
    for k, v in LANGUAGES.items():
        out = out.when(ext == k, v)
    return out.otherwise("unknown")


def source_tree(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(files (path, language, content), skipped (path, reason)). Sizes are checked before contents are read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    tagged = raw.withColumn("language", language(F.col("path")))
    vendor = F.col("path").rlike("/(" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + ")/")
    reason = F.when(vendor, "vendor folder").when(F.col("language") == "unknown", "extension").when(F.col("length") > max_bytes, "too large")
    tagged = tagged.withColumn("reason", reason)
    files = tagged.where("reason is null").select("path", "language", F.decode("content", "UTF-8").alias("content"))
    return files, tagged.where("reason is not null").select("path", "reason")


def export_csv(findings: DataFrame, path: str, columns: list[str], order: list[str], limit: int = 10_000) -> None:
    """At most ``limit`` rows in a fixed order under a fixed header (the limit is the export's contract)."""
    findings.select(columns).orderBy(*order).limit(limit).write.mode("overwrite").option("header", True).csv(path)


def export_xml(findings: DataFrame, path: str, row: str = "finding", root: str = "findings") -> None:
    findings.write.mode("overwrite").format("xml").option("rowTag", row).option("rootTag", root).save(path)


def replace_partition(df: DataFrame, path: str, key: str) -> None:
    """Only the partitions of ``key`` that ``df`` holds are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
