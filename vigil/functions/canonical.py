"""Hashes of documents that do not depend on the order of their keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(value: Column) -> Column:
    """A JSON string, null as such. Letters beyond ASCII stay as they are."""
    quoted = F.to_json(F.array(value))
    return F.when(value.isNull(), F.lit("null")).otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def number(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("null"))


def items(values: Column) -> Column:
    """A JSON array of JSON texts, in their order."""
    return F.concat(F.lit("["), F.array_join(values, ", "), F.lit("]"))


def fields(**values: Column) -> Column:
    """A JSON object of JSON texts, its keys sorted."""
    pairs = [F.concat(F.lit(f'"{k}": '), values[k]) for k in sorted(values)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}"))


def digest(json: Column) -> Column:
    return F.sha2(json, 256)
