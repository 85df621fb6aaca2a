"""Filters, pages, top-k, ordered deduplication, upserts and diffs.

All of them are declarative: keys decide the shuffle, order columns always end in a unique key so that results do not
depend on the partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def conjunction(df: DataFrame, *, equal: dict | None = None, like: dict[tuple[str, ...], str] | None = None, at_least: dict | None = None, at_most: dict | None = None, within: dict[str, list] | None = None, flag: tuple[str, bool] | None = None) -> DataFrame:
    """All given conditions; a condition whose value is None is left out.

    equal: column = value. like: any of the columns contains the text, whatever its case. flag: (column, wanted), null
    counts as false. within: column in list. at_least, at_most: bounds, both included.
    """
    parts: list[Column] = [F.col(c) == v for c, v in (equal or {}).items() if v is not None]
    parts += [reduce(lambda a, b: a | b, [F.lower(F.col(c)).contains(v.lower()) for c in cols]) for cols, v in (like or {}).items() if v]
    parts += [F.col(c) >= F.lit(v) for c, v in (at_least or {}).items() if v is not None]
    parts += [F.col(c) <= F.lit(v) for c, v in (at_most or {}).items() if v is not None]
    parts += [F.col(c).isin(v) for c, v in (within or {}).items() if v is not None]
    if flag is not None:
        parts.append(F.coalesce(F.col(flag[0]).cast("boolean"), F.lit(False)) == flag[1])
    return df.where(reduce(lambda a, b: a & b, parts)) if parts else df


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1); a take-ordered plan, not a full sort."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def pages(total: Column, size: int) -> Column:
    return F.ceil(total / F.lit(size)).cast("long")


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """The first k rows per key; with k = 1 the latest-per-entity pattern."""
    out = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= k)
    return out.withColumnRenamed("_rn", rank) if rank else out.drop("_rn")


def first_writer(parts: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """Union of sources in order of precedence; of rows with one key the earliest source's first stays."""
    tagged = [p.withColumn("_source", F.lit(i)) for i, p in enumerate(parts)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return top_per(both, keys, [F.col("_source"), *map(F.col, order)]).drop("_source")


def newest_with_key(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """Newest row per key; rows whose key is null are no duplicates and all stay."""
    keyed = df.withColumn("_key", key)
    return top_per(keyed.where("_key is not null"), ["_key"], order).unionByName(keyed.where("_key is null")).drop("_key")


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows to append: those of ``new`` whose key is new, one per key."""
    return top_per(new, keys, [F.col(c) for c in order]).join(existing.select(keys).distinct(), keys, "left_anti")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Last write wins per key."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return top_per(both, keys, [F.col("_new").desc(), *order]).drop("_new")


def merge_sightings(df: DataFrame, keys: list[str], first: str, last: str, rest: list[str]) -> DataFrame:
    """One row per indicator: least first and greatest last sighting, the rest from the latest row."""
    latest = [F.max_by(F.col(c), F.col(last)).alias(c) for c in rest]
    return df.groupBy(*keys).agg(F.min(first).alias(first), F.max(last).alias(last), *latest)


def interval_join(left: DataFrame, right: DataFrame, at: str, start: str, end: str, width: int, how: str = "inner") -> DataFrame:
    """left rows with the right intervals [start, end] that hold left.at (numbers, or epoch seconds).

    Intervals are cut into buckets of ``width``, which makes a range join an equi-join; the condition is checked after.
    """
    a = left.withColumn("_b", F.floor(F.col(at) / width))
    b = right.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return a.join(b, (a["_b"] == b["_b"]) & (F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end)), how).drop("_b")


def diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, status, changed): added, removed, modified or unchanged, with the fields that differ (nulls are equal)."""
    o = old.select(F.col(key).alias("_ok"), *[F.col(c).alias(f"_o_{c}") for c in fields])
    n = new.select(F.col(key).alias("_nk"), *[F.col(c).alias(f"_n_{c}") for c in fields])
    both = o.join(n, F.col("_ok") == F.col("_nk"), "full_outer")
    changed = F.filter(F.array(*[F.when(~F.col(f"_o_{c}").eqNullSafe(F.col(f"_n_{c}")), F.lit(c)) for c in fields]), lambda x: x.isNotNull())
    status = F.when(F.col("_ok").isNull(), "added").when(F.col("_nk").isNull(), "removed").when(F.size(changed) > 0, "modified").otherwise("unchanged")
    return both.select(F.coalesce("_ok", "_nk").alias(key), status.alias("status"), F.when(status == "modified", F.array_join(changed, ",")).otherwise("").alias("changed"))
