"""Counts by day with a calendar, rolling baselines and anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def calendar(df: DataFrame, day: str) -> DataFrame:
    """One row per day between the first and last ``day`` of ``df``; one aggregate, then a generated sequence."""
    ends = df.agg(F.min(day).alias("a"), F.max(day).alias("b")).where("a is not null")
    return ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias(day))


def daily_levels(df: DataFrame, at: str, level: str, levels: list[str]) -> DataFrame:
    """Counts per day and level as columns, days without rows as zeros."""
    days = df.select(F.to_date(at).alias("day"), level)
    counts = days.groupBy("day").agg(*[F.count(F.when(F.col(level) == x, 1)).alias(x) for x in levels])
    return calendar(days, "day").join(counts, "day", "left").na.fill(0, levels)


def rolling(df: DataFrame, key: str, order: list[str], value: str, last: int = 60) -> DataFrame:
    """Baseline of the ``last`` rows before each row of a key: n, mean, population deviation (at least 1), p90.

    p90 is the nearest rank, element min(floor(n * 90 / 100), n - 1) of the sorted values.
    """
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-last, -1)
    out = df.withColumn("prior_n", F.count(value).over(w)).withColumn("prior_mean", F.avg(value).over(w))
    out = out.withColumn("prior_std", F.greatest(F.lit(1.0), F.stddev_pop(value).over(w)))
    return out.withColumn("prior_p90", nearest_rank(F.collect_list(value).over(w), 90))


def nearest_rank(values: Column, percent: int) -> Column:
    s = F.sort_array(values)
    return F.when(F.size(values) > 0, F.element_at(s, (F.least(F.floor(F.size(values) * percent / 100), F.size(values) - 1) + 1).cast("int")))


def maturity(n: Column) -> Column:
    """How far a baseline carries: fewer than 5 rows are learning, fewer than 20 partial."""
    return F.when(n < 5, "learning").when(n < 20, "partial").otherwise("established")


def anomalies(baselined: DataFrame, value: str, z_high: float = 3.0, z_low: float = 2.0) -> DataFrame:
    """z-scores against the baseline before the row; with a partial one the p90 decides instead."""
    z = (F.col(value) - F.col("prior_mean")) / F.col("prior_std")
    status = maturity(F.col("prior_n"))
    found = F.when(status == "learning", F.lit(None)).when(status == "partial", F.when(F.col(value) > F.col("prior_p90") * 1.5, "medium")).when(z >= z_high, "high").when(z >= z_low, "medium")
    return baselined.withColumn("status", status).withColumn("z", z).withColumn("severity", found).where("severity is not null")
