"""Asks of a cache whose entries expire; errors and signups of a user stand for answers, all else for asks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import caches as K
from .registry import query, table


@query("""
WITH e AS (SELECT user_id AS key, event_id AS row_id, ts AS t, event_type NOT IN ('error', 'signup') AS ask, CASE WHEN event_id % 10 <> 0 THEN event_type || ':' || event_id END AS value FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
h AS (SELECT a.key, a.row_id, a.t, b.t AS since, b.value FROM (FROM e WHERE ask) a ASOF LEFT JOIN (FROM e WHERE NOT ask) b ON a.key = b.key AND a.t >= b.t)
SELECT key::VARCHAR AS key, row_id, CASE WHEN epoch_ms(t) <= epoch_ms(since) + 6 * 3600000 THEN 'hit' ELSE 'miss' END AS outcome, CASE WHEN epoch_ms(t) <= epoch_ms(since) + 6 * 3600000 THEN value END AS value FROM h
""")
def cache_outcomes(spark, sf_dir):
    """Hits and misses of all asks against answers of at most six hours before."""
    e = table(spark, sf_dir, "events")
    value = F.when(F.col("event_id") % 10 != 0, F.concat_ws(":", "event_type", F.col("event_id").cast("string")))
    rows = e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("row_id"), F.col("ts").cast("timestamp").alias("at"), (~F.col("event_type").isin("error", "signup")).alias("ask"), value.alias("value"))
    return K.cached_batch(rows, 6).select("key", "row_id", "outcome", "value")
