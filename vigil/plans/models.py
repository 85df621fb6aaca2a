"""Scores, coverage and versioned-model analytics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import severity as S
from ..operators import relational as R
from ..operators import textscan as T
from .registry import SQL, query, table

_STRIDE_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(t), '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in K.STRIDE) + " ELSE 'tampering' END"


@query(f"SELECT doc_id, {_STRIDE_SQL} AS class FROM (SELECT doc_id, text || source AS t FROM documents)")
def stride_class(spark, sf_dir):
    """Ordered keyword classes over the whole text; the first that fits."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", K.first_class(F.concat("text", "source")).alias("class"))


@query(SQL["stride_class"])
def stride_class_whole(spark, sf_dir):
    """The same under its second name."""
    return table(spark, sf_dir, "documents").select("doc_id", K.first_class(F.concat("text", "source")).alias("class"))


@query("""
SELECT event_id, round((CASE event_type WHEN 'error' THEN 1.0 WHEN 'purchase' THEN 0.8 WHEN 'signup' THEN 0.6 ELSE 0.4 END)::DOUBLE * CASE WHEN user_id % 3 = 0 THEN 1.5 ELSE 1.0 END::DOUBLE
  * CASE WHEN date_diff('day', ts::DATE, DATE '2024-01-31') <= 7 THEN 1.3 WHEN date_diff('day', ts::DATE, DATE '2024-01-31') <= 30 THEN 1.1 ELSE 1.0 END::DOUBLE * (1 + least(10.0, value / 10) / 20) * CASE WHEN event_id % 2 = 0 THEN 1.1 ELSE 1.0 END::DOUBLE, 10) AS score FROM events
""")
def match_score(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    base = F.when(F.col("event_type") == "error", 1.0).when(F.col("event_type") == "purchase", 0.8).when(F.col("event_type") == "signup", 0.6).otherwise(0.4)
    age = F.datediff(F.lit("2024-01-31").cast("date"), F.to_date("ts"))
    return e.select("event_id", F.round(K.match_score(base, F.col("user_id") % 3 == 0, age, F.least(F.lit(10.0), F.col("value") / 10), F.col("event_id") % 2 == 0), 10).alias("score"))


@query("""
SELECT s_suppkey, round(least(10.0, s_acctbal / 1000 + CASE WHEN s_nationkey < 5 THEN 1.0 ELSE 0 END + CASE WHEN s_nationkey % 2 = 0 THEN 0.5 ELSE 0 END + CASE WHEN s_suppkey % 3 = 0 THEN 0.5 ELSE 0 END), 6) AS risk FROM supplier
""")
def adjusted_risk(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", F.round(K.adjusted_risk(F.col("s_acctbal") / 1000, F.col("s_nationkey") < 5, F.col("s_nationkey") % 2 == 0, F.col("s_suppkey") % 3 == 0), 6).alias("risk"))


@query("""
SELECT c_custkey, greatest(0, least(100, 100 - least(30, count(*) FILTER (o_orderstatus = 'F') * 5) - least(20, count(*) FILTER (o_orderpriority = '1-URGENT') * 4) + CASE WHEN count(*) FILTER (o_orderstatus = 'P') > 0 THEN 5 ELSE 0 END))::BIGINT AS score
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
""")
def security_score(spark, sf_dir):
    """Deductions with caps and bonuses on a scale of 100."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(*[F.count_if(c).alias(n) for n, c in (("f", F.col("o_orderstatus") == "F"), ("u", F.col("o_orderpriority") == "1-URGENT"), ("p", F.col("o_orderstatus") == "P"))])
    j = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").na.fill(0, ["f", "u", "p"])
    score = F.lit(100) - F.least(F.lit(30), F.col("f") * 5) - F.least(F.lit(20), F.col("u") * 4) + F.when(F.col("p") > 0, 5).otherwise(0)
    return j.select("c_custkey", F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("long").alias("score"))


@query("""
WITH d AS (SELECT s_nationkey AS k, count(*) FILTER (s_suppkey % 7 = 0) AS added, count(*) FILTER (s_suppkey % 11 = 0) AS removed, count(*) FILTER (s_suppkey % 5 = 0) AS modified FROM supplier GROUP BY 1)
SELECT k, round(least(1.0, added * 0.15 + removed * 0.1 + modified * 0.05), 6)::DOUBLE AS impact FROM d
""")
def impact_score(spark, sf_dir):
    """Weighted changes, at most 1."""
    g = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.sum(F.when(F.col("s_suppkey") % 7 == 0, 0.15).otherwise(0.0) + F.when(F.col("s_suppkey") % 11 == 0, 0.1).otherwise(0.0) + F.when(F.col("s_suppkey") % 5 == 0, 0.05).otherwise(0.0)).alias("w"))
    return g.select("k", F.round(F.least(F.lit(1.0), F.col("w")), 6).alias("impact"))


@query("""
SELECT p_brand AS standard, count(*) AS mappings, count(DISTINCT p_type) AS controls, round(avg(p_size / 50.0), 6) AS relevance FROM part GROUP BY p_brand
""")
def compliance_summary(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("standard")).agg(F.count("*").alias("mappings"), F.countDistinct("p_type").alias("controls"), F.round(F.avg(F.col("p_size") / 50.0), 6).alias("relevance"))


@query("""
SELECT t.event_type, r.bucket, count(e.event_id) AS n FROM (SELECT DISTINCT event_type FROM events) t CROSS JOIN (SELECT unnest(['low', 'mid', 'high']) AS bucket) r
LEFT JOIN events e ON e.event_type = t.event_type AND CASE WHEN e.value > 90 THEN 'high' WHEN e.value > 50 THEN 'mid' ELSE 'low' END = r.bucket GROUP BY ALL
""")
def feedback_stats(spark, sf_dir):
    """Type by rating with zeros: a pivot over the fixed ratings, no product."""
    e = table(spark, sf_dir, "events")
    b = F.when(F.col("value") > 90, "high").when(F.col("value") > 50, "mid").otherwise("low")
    g = e.groupBy("event_type").agg(*[F.count_if(b == x).alias(x) for x in ("low", "mid", "high")])
    return g.unpivot("event_type", ["low", "mid", "high"], "bucket", "n")


@query("""
WITH c AS (SELECT s_suppkey, unnest(['n' || s_nationkey, 'r' || (s_suppkey % 4)]) AS target, s_acctbal FROM supplier)
SELECT target, count(*) AS controls, count(DISTINCT s_suppkey % 10) AS kinds, round(avg(CASE WHEN s_acctbal < 0 THEN 0.7 ELSE least(1.0, s_acctbal / 10000) END), 9) AS effectiveness FROM c GROUP BY target
""")
def controls_coverage(spark, sf_dir):
    """Arrays of linked ids exploded and grouped."""
    s = table(spark, sf_dir, "supplier").withColumn("target", F.explode(F.array(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), F.concat(F.lit("r"), (F.col("s_suppkey") % 4).cast("string")))))
    return s.groupBy("target").agg(F.count("*").alias("controls"), F.countDistinct(F.col("s_suppkey") % 10).alias("kinds"), F.round(F.avg(F.when(F.col("s_acctbal") < 0, 0.7).otherwise(F.least(F.lit(1.0), F.col("s_acctbal") / 10000))), 9).alias("effectiveness"))


@query("""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS line_number, unnest(string_split(text, chr(10))) AS line FROM documents),
m AS (SELECT *, bool_or(regexp_matches(line, '(?i)licen[sc]e')) OVER (PARTITION BY doc_id ORDER BY line_number ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS clean FROM l)
SELECT doc_id, line_number, clean FROM m WHERE length(line) BETWEEN 20 AND 60
""")
def sanitizer_context(spark, sf_dir):
    """Was there a sanitizer on the line or the four before it."""
    l = T.lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    w = Window.partitionBy("doc_id").orderBy("line_number").rowsBetween(-4, 0)
    return l.withColumn("clean", F.bool_or(F.col("line").rlike("(?i)licen[sc]e")).over(w)).where(F.length("line").between(20, 60)).select("doc_id", "line_number", "clean")


@query("""
WITH l AS (SELECT conv_id, turn, role, text FROM conversations), m AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) % 2 AS open FROM l)
SELECT conv_id, turn, open = 1 AS inside FROM m
""")
def block_parity(spark, sf_dir):
    """Open or closed by the parity of toggles so far: the state of docstrings and block comments."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", (F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w) % 2 == 1).alias("inside"))


@query("""
WITH a AS (SELECT s_suppkey AS id, s_name AS name, 'manual' AS origin FROM supplier WHERE s_suppkey % 3 = 0), b AS (SELECT s_suppkey + 1 AS id, s_name AS name, 'extracted' AS origin FROM supplier WHERE s_suppkey % 2 = 0)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE id NOT IN (SELECT id FROM a) AND name NOT IN (SELECT name FROM a)
""")
def merge_architectures(spark, sf_dir):
    """Two component lists merged: a manual one wins by id or by name."""
    s = table(spark, sf_dir, "supplier")
    a = s.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("manual").alias("origin"))
    b = s.where("s_suppkey % 2 = 0").select((F.col("s_suppkey") + 1).alias("id"), F.col("s_name").alias("name"), F.lit("extracted").alias("origin"))
    return a.unionByName(b.join(a.select("id"), "id", "left_anti").join(a.select("name"), "name", "left_anti").select("id", "name", "origin"))


@query("""
WITH e AS (SELECT DISTINCT n_nationkey AS id FROM nation WHERE n_nationkey % 3 = 0), f AS (SELECT (n_nationkey * 2) % 25 AS src, (n_nationkey * 5 + 1) % 25 AS dst FROM nation WHERE n_regionkey = 1)
SELECT id FROM e WHERE id NOT IN (SELECT src FROM f UNION SELECT dst FROM f)
""")
def orphan_components(spark, sf_dir):
    """Components that no flow touches."""
    n = table(spark, sf_dir, "nation")
    f = n.where("n_regionkey = 1").selectExpr("(n_nationkey * 2) % 25 AS src", "(n_nationkey * 5 + 1) % 25 AS dst")
    return n.where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("id")).distinct().join(f.select(F.col("src").alias("id")).union(f.select("dst")), "id", "left_anti")


@query("""
WITH t AS (SELECT l_orderkey, l_linenumber AS tech, CASE WHEN l_quantity >= 45 THEN 'critical' WHEN l_quantity >= 30 THEN 'high' WHEN l_quantity >= 15 THEN 'medium' ELSE 'low' END AS severity, l_partkey FROM lineitem)
SELECT tech, count(*) AS n, count(DISTINCT l_partkey) AS components, arg_max(severity, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS worst FROM t GROUP BY tech
""")
def technique_rollup(spark, sf_dir):
    """Counts, distinct components and the worst severity by rank."""
    sev = F.expr("CASE WHEN l_quantity >= 45 THEN 'critical' WHEN l_quantity >= 30 THEN 'high' WHEN l_quantity >= 15 THEN 'medium' ELSE 'low' END")
    l = table(spark, sf_dir, "lineitem").withColumn("severity", sev)
    return l.groupBy(F.col("l_linenumber").alias("tech")).agg(F.count("*").alias("n"), F.countDistinct("l_partkey").alias("components"), F.max_by("severity", S.rank(F.col("severity"))).alias("worst"))


@query("""
WITH l AS (SELECT quality AS truth, CASE WHEN n_chars > 100 THEN 1 ELSE 0 END AS found FROM labels JOIN documents USING (doc_id)),
m AS (SELECT count(*) FILTER (truth = 1 AND found = 1) AS tp, count(*) FILTER (truth = 0 AND found = 1) AS fp, count(*) FILTER (truth = 1 AND found = 0) AS fn, count(*) FILTER (truth = 0 AND found = 0) AS tn FROM l)
SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision_, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(fp / nullif(fp + tn, 0), 6) AS fpr FROM m
""")
def scanner_quality(spark, sf_dir):
    """Precision, recall, F1, accuracy and false-positive rate of a detector against labels."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 100).alias("found"))
    j = table(spark, sf_dir, "labels").join(d, "doc_id")
    t, f = F.col("quality") == 1, F.col("found")
    m = j.agg(F.count_if(t & f).alias("tp"), F.count_if(~t & f).alias("fp"), F.count_if(t & ~f).alias("fn"), F.count_if(~t & ~f).alias("tn"))
    r = lambda a, b: F.round(F.try_divide(F.expr(a), F.expr(b)), 6)
    return m.select("tp", "fp", "fn", "tn", r("tp", "tp + fp").alias("precision_"), r("tp", "tp + fn").alias("recall"), r("2 * tp", "2 * tp + fp + fn").alias("f1"), r("tp + tn", "tp + fp + fn + tn").alias("accuracy"), r("fp", "fp + tn").alias("fpr"))


@query("""
SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS successor, last_value(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS as_of FROM orders
""")
def successor_and_as_of(spark, sf_dir):
    """Linear successors, and the last failed row before each: an as-of join as a window."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.lead("o_orderkey").over(w).alias("successor"), F.last(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")), ignorenulls=True).over(before).alias("as_of"))


@query("""
SELECT r_name AS project, w.status, count(*) AS n FROM nation JOIN region ON r_regionkey = n_regionkey JOIN (SELECT c_nationkey, CASE WHEN c_acctbal > 5000 THEN 'done' WHEN c_acctbal > 0 THEN 'doing' ELSE 'todo' END AS status FROM customer) w ON w.c_nationkey = n_nationkey GROUP BY ALL
""")
def story_summary(spark, sf_dir):
    """Ownership joins with a derived status; small dimensions are broadcast by their statistics."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", F.when(F.col("c_acctbal") > 5000, "done").when(F.col("c_acctbal") > 0, "doing").otherwise("todo").alias("status"))
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy(F.col("r_name").alias("project"), "status").agg(F.count("*").alias("n"))


@query("""
WITH v AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders)
SELECT o_custkey, max(version) AS version, arg_max(o_orderkey, version) AS latest, count(*) FILTER (o_orderstatus = 'O') AS open FROM v GROUP BY o_custkey
""")
def version_history(spark, sf_dir):
    v = table(spark, sf_dir, "orders").withColumn("version", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long"))
    return v.groupBy("o_custkey").agg(F.max("version").alias("version"), F.max_by("o_orderkey", "version").alias("latest"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))


@query("""
SELECT n_name, max_ FROM (SELECT n_name, max(s_acctbal) AS max_, row_number() OVER (ORDER BY max(s_acctbal) DESC, n_name) AS rn FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name) WHERE rn <= 20
""")
def sector_top(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    g = s.join(n, s["s_nationkey"] == n["n_nationkey"]).groupBy("n_name").agg(F.max("s_acctbal").alias("max_"))
    return R.page(g, [F.col("max_").desc(), F.col("n_name")], 1, 20)
