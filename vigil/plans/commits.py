"""Commit-stream analytics; the events table stands for commits (user_id the author, value the risk)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import severity as S
from ..operators import relational as R
from ..operators import timeline as T
from .registry import query, table

TYPES = ["click", "error", "purchase", "signup", "view"]
_LEVEL = "CASE WHEN value >= 75 THEN 'critical' WHEN value >= 50 THEN 'high' WHEN value >= 25 THEN 'medium' WHEN value > 0 THEN 'low' ELSE 'clean' END"


def _commits(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("level", F.expr(_LEVEL))


@query(f"""
WITH e AS (SELECT CAST(ts AS DATE) AS day, {_LEVEL} AS level FROM events),
c AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM e), (SELECT max(day) FROM e), INTERVAL 1 DAY)) AS DATE) AS day)
SELECT c.day, count(*) FILTER (level = 'critical') AS critical, count(*) FILTER (level = 'high') AS high,
  count(*) FILTER (level = 'medium') AS medium, count(*) FILTER (level = 'low') AS low, count(*) FILTER (level = 'clean') AS clean
FROM c LEFT JOIN e ON e.day = c.day GROUP BY c.day
""")
def risk_timeline_gapfilled(spark, sf_dir):
    """Commits per day and risk level over the whole calendar."""
    return T.daily_levels(_commits(spark, sf_dir), "ts", "level", ["critical", "high", "medium", "low", "clean"])


@query("""
SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS commits, round(avg(value), 4) AS avg_risk, max(value) AS max_risk,
  CAST(sum(CASE WHEN event_type IN ('error', 'signup') THEN 1 ELSE 0 END) AS BIGINT) AS flagged
FROM events GROUP BY 1, 2
""")
def developer_daily_activity(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("commits"), F.round(F.avg("value"), 4).alias("avg_risk"), F.max("value").alias("max_risk"),
        F.sum(F.when(F.col("event_type").isin("error", "signup"), 1).otherwise(0)).alias("flagged"),
    )


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events),
l AS (SELECT * FROM r WHERE rn <= 60)
SELECT user_id, count(*) AS n, round(avg(value), 4) AS mean, round(greatest(1.0, stddev_pop(value)), 4) AS std,
  list_sort(list(value))[CAST(least(floor(count(*) * 90 / 100), count(*) - 1) AS INTEGER) + 1] AS p90,
  CASE WHEN count(*) < 5 THEN 'learning' WHEN count(*) < 20 THEN 'partial' ELSE 'established' END AS status,
  round(count(*) / greatest(1.0, date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) / 7.0), 4) AS per_week
FROM l GROUP BY user_id
""")
def developer_baseline(spark, sf_dir):
    """Baseline of the last 60 commits of each author."""
    last = R.top_per(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 60)
    return last.groupBy("user_id").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.greatest(F.lit(1.0), F.stddev_pop("value")), 4).alias("std"),
        T.nearest_rank(F.collect_list("value"), 90).alias("p90"), T.maturity(F.count("*")).alias("status"),
        F.round(F.count("*") / F.greatest(F.lit(1.0), F.datediff(F.to_date(F.max("ts")), F.to_date(F.min("ts"))) / F.lit(7.0)), 4).alias("per_week"),
    )


@query("""
WITH w AS (SELECT event_id, user_id, value, count(value) OVER p AS n, avg(value) OVER p AS m, greatest(1.0, stddev_pop(value) OVER p) AS s, list_sort(list(value) OVER p) AS v
  FROM events WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
x AS (SELECT event_id, user_id, value, n, CASE WHEN n < 5 THEN 'learning' WHEN n < 20 THEN 'partial' ELSE 'established' END AS status, (value - m) / s AS z,
  v[CAST(least(floor(n * 90 / 100), n - 1) AS INTEGER) + 1] AS p90 FROM w),
y AS (SELECT *, CASE WHEN status = 'learning' THEN NULL WHEN status = 'partial' THEN CASE WHEN value > p90 * 1.5 THEN 'medium' END WHEN z >= 3 THEN 'high' WHEN z >= 2 THEN 'medium' END AS severity FROM x)
SELECT event_id, user_id, CAST(n AS BIGINT) AS prior_n, status, severity, round(z, 4) AS z FROM y WHERE severity IS NOT NULL
""")
def developer_anomalies(spark, sf_dir):
    """Commits that stand out against what their author did before them."""
    b = T.rolling(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")
    return T.anomalies(b, "value").select("event_id", "user_id", "prior_n", "status", "severity", F.round("z", 4).alias("z"))


@query(f"""
SELECT user_id, round(least(10.0, log10(sum(CASE {_LEVEL} WHEN 'critical' THEN 10 WHEN 'high' THEN 7 WHEN 'medium' THEN 4 WHEN 'low' THEN 1 ELSE 0 END) + 1) * 3), 6) AS risk_score, count(*) AS findings
FROM events GROUP BY user_id
""")
def project_risk_score(spark, sf_dir):
    """Weighted findings per project on a logarithmic scale of 0 to 10."""
    return _commits(spark, sf_dir).groupBy("user_id").agg(F.round(S.scaled_risk(F.sum(S.weight(F.col("level")))), 6).alias("risk_score"), F.count("*").alias("findings"))


@query("""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events
""")
def json_props(spark, sf_dir):
    """JSON column read by path, with a default for an absent key."""
    e = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k long, missing string"))
    return e.select("event_id", F.col("p.k").alias("k"), F.coalesce("p.missing", F.lit("none")).alias("missing"))


@query("""
SELECT event_id, CAST(ts AS DATE) AS day, CAST(hour(ts) AS INTEGER) AS hour, hour(ts) < 7 OR hour(ts) >= 21 AS off_hours,
  date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') AS age_days,
  CASE WHEN date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') <= 7 THEN 1.3 WHEN date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') <= 30 THEN 1.1 ELSE 1.0 END::DOUBLE AS boost
FROM events WHERE event_type IN ('error', 'purchase') AND value >= 20 AND ts >= TIMESTAMP '2024-01-05'
""")
def commit_metadata_signals(spark, sf_dir):
    """Filter builder, local hour, off-hours and recency boost at an explicit as-of date."""
    e = R.conjunction(table(spark, sf_dir, "events"), within={"event_type": ["error", "purchase"]}, at_least={"value": 20})
    e = e.where("ts >= timestamp_ntz '2024-01-05 00:00:00'")
    age = F.datediff(F.lit("2024-01-31").cast("date"), F.to_date("ts"))
    return e.select("event_id", F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), ((F.hour("ts") < 7) | (F.hour("ts") >= 21)).alias("off_hours"), age.cast("long").alias("age_days"), F.when(age <= 7, 1.3).when(age <= 30, 1.1).otherwise(1.0).alias("boost"))


@query("""
SELECT event_id, ts, user_id, event_type, value FROM events WHERE value > 10 AND (lower(event_type) LIKE '%err%' OR lower(event_type) LIKE '%view%')
ORDER BY CASE event_type WHEN 'error' THEN 0 ELSE 1 END, ts DESC, event_id LIMIT 25 OFFSET 50
""")
def commits_page(spark, sf_dir):
    """Third page of 25 of a filtered list, severe ones first."""
    e = table(spark, sf_dir, "events").where((F.col("value") > 10) & (F.lower("event_type").contains("err") | F.lower("event_type").contains("view")))
    order = [F.when(F.col("event_type") == "error", 0).otherwise(1), F.col("ts").desc(), F.col("event_id")]
    return R.page(e, order, 3, 25).select("event_id", "ts", "user_id", "event_type", "value")


@query("""
SELECT count(*) AS total, CAST(ceil(count(*) / 25.0) AS BIGINT) AS pages, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT user_id) AS authors,
  round(avg(value), 4) AS avg_value, round(sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END), 2) AS error_value FROM events
""")
def summary_counts(spark, sf_dir):
    """All scalar measures of the dashboard in one pass."""
    return table(spark, sf_dir, "events").agg(
        F.count("*").alias("total"), R.pages(F.count("*"), 25).alias("pages"), F.count_if(F.col("event_type") == "error").alias("errors"), F.countDistinct("user_id").alias("authors"),
        F.round(F.avg("value"), 4).alias("avg_value"), F.round(F.sum(F.when(F.col("event_type") == "error", F.col("value")).otherwise(0.0)), 2).alias("error_value"),
    )


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
s AS (SELECT user_id, CASE event_type WHEN 'error' THEN least(n * 1.5, 4.0) WHEN 'signup' THEN least(n * 1.0, 3.0) WHEN 'purchase' THEN least(n * 0.5, 2.0) ELSE 0.0 END AS w FROM c)
SELECT user_id, CAST(round(least(10.0, sum(w)), 4) AS DOUBLE) AS score, CASE WHEN sum(w) >= 7 THEN 'critical' WHEN sum(w) >= 4 THEN 'high' WHEN sum(w) >= 2 THEN 'medium' WHEN sum(w) >= 0.5 THEN 'low' ELSE 'clean' END AS level
FROM s GROUP BY user_id
""")
def capped_signal_score(spark, sf_dir):
    """Signals weighted with a cap per kind, summed and capped, then bucketed."""
    n = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    w = F.when(F.col("event_type") == "error", F.least(F.col("n") * 1.5, F.lit(4.0))).when(F.col("event_type") == "signup", F.least(F.col("n") * 1.0, F.lit(3.0))).when(F.col("event_type") == "purchase", F.least(F.col("n") * 0.5, F.lit(2.0))).otherwise(0.0)
    return n.groupBy("user_id").agg(F.round(F.least(F.lit(10.0), F.sum(w)), 4).alias("score"), S.level(F.sum(w)).alias("level"))


@query("""
WITH o AS (SELECT * FROM events WHERE event_id % 3 = 0), n AS (SELECT * FROM events WHERE event_id % 2 = 0)
SELECT user_id, event_type, count(*) AS appended FROM (SELECT n.* FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.event_id = n.event_id)) GROUP BY ALL
""")
def insert_ignore_commits(spark, sf_dir):
    """Append only commits that were not seen: the anti-join twin of the streaming ingest."""
    e = table(spark, sf_dir, "events")
    return R.insert_ignore(e.where("event_id % 3 = 0"), e.where("event_id % 2 = 0"), ["event_id"], ["ts"]).groupBy("user_id", "event_type").agg(F.count("*").alias("appended"))


@query("""
SELECT user_id, event_type, min(ts) AS first_seen, max(ts) AS last_seen, arg_max(value, ts) AS value FROM events GROUP BY ALL
""")
def merge_ioc_sightings(spark, sf_dir):
    """Indicators merged on their key: first and last sighting, the latest confidence."""
    e = table(spark, sf_dir, "events").withColumns({"first_seen": F.col("ts"), "last_seen": F.col("ts")})
    return R.merge_sightings(e, ["user_id", "event_type"], "first_seen", "last_seen", ["value"])


@query("""
WITH x AS (SELECT user_id, value, ts, event_id, 0 AS w FROM events WHERE ts < TIMESTAMP '2024-01-15' UNION ALL SELECT user_id, value, ts, event_id, 1 FROM events WHERE ts >= TIMESTAMP '2024-01-15'),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, ts DESC, event_id DESC) AS rn FROM x)
SELECT user_id, value, ts FROM r WHERE rn = 1
""")
def upsert_profiles(spark, sf_dir):
    """Profiles upserted by author, last write wins."""
    e = table(spark, sf_dir, "events").select("user_id", "value", "ts", "event_id")
    cut = F.expr("timestamp_ntz '2024-01-15 00:00:00'")
    return R.upsert(e.where(F.col("ts") < cut), e.where(F.col("ts") >= cut), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "value", "ts")
