"""Rules as text for other scanners; one row per rule, written by any file sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))


def semgrep(rules: DataFrame) -> DataFrame:
    """(id, document) of rules (id, pattern, severity, language, message): a regex rule in YAML."""
    level = F.when(F.col("severity").isin("critical", "high"), "ERROR").when(F.col("severity") == "medium", "WARNING").otherwise("INFO")
    lang = F.when(F.col("language") == "*", "generic").otherwise(F.col("language"))
    return rules.select("id", F.concat(F.lit("rules:\n  - id: "), "id", F.lit("\n    languages: ["), lang, F.lit("]\n    severity: "), level, F.lit("\n    message: "), _quoted(F.col("message")), F.lit("\n    pattern-regex: "), _quoted(F.col("pattern")), F.lit("\n")).alias("document"))


def sarif_rule(rules: DataFrame) -> DataFrame:
    """(id, document): the rule's descriptor as JSON."""
    body = F.struct("id", F.struct(F.col("message").alias("text")).alias("shortDescription"), F.struct(F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("note").alias("level")).alias("defaultConfiguration"))
    return rules.select("id", F.to_json(body).alias("document"))
