"""Relational analytics; orders stand for scans, customers for projects, lineitem for findings, nations for sectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import severity as S
from ..operators import relational as R
from .registry import SQL, query, table

_SEV = "CASE WHEN l_quantity >= 45 THEN 'critical' WHEN l_quantity >= 30 THEN 'high' WHEN l_quantity >= 15 THEN 'medium' ELSE 'low' END"


def _findings(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumn("severity", F.expr(_SEV))


@query("""
SELECT c_custkey, count(o_orderkey) AS scans, count(*) FILTER (o_orderstatus = 'F') AS failed, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'P') AS pending,
  max(o_totalprice) AS peak, round(avg(o_totalprice), 6) AS mean FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
""")
def repo_stats_pivot(spark, sf_dir):
    """Counts per status as columns, peak and mean; customers without orders stay. Orders are aggregated before the join."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("scans"), *[F.count_if(F.col("o_orderstatus") == k).alias(n) for k, n in (("F", "failed"), ("O", "open"), ("P", "pending"))], F.max("o_totalprice").alias("peak"), F.round(F.avg("o_totalprice"), 6).alias("mean"))
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").drop("o_custkey").na.fill(0, ["scans", "failed", "open", "pending"])


@query("""
SELECT count(*) AS total, count(*) FILTER (l_linestatus = 'F') AS fixed, round(100.0 * count(*) FILTER (l_returnflag = 'R') / count(*), 4) AS fp_rate,
  round(avg(date_diff('day', o_orderdate, l_shipdate)) FILTER (l_linestatus = 'F'), 4) AS mean_days_to_fix,
  round(count(*) FILTER (l_linestatus = 'F') / greatest(1.0, date_diff('day', min(o_orderdate), max(o_orderdate)) / 7.0), 4) AS velocity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")
def dashboard_kpis(spark, sf_dir):
    l, o = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linestatus", "l_returnflag", "l_shipdate"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    j = l.join(o, l["l_orderkey"] == o["o_orderkey"])
    fixed = F.col("l_linestatus") == "F"
    return j.agg(
        F.count("*").alias("total"), F.count_if(fixed).alias("fixed"), F.round(100.0 * F.count_if(F.col("l_returnflag") == "R") / F.count("*"), 4).alias("fp_rate"),
        F.round(F.avg(F.when(fixed, F.datediff("l_shipdate", "o_orderdate"))), 4).alias("mean_days_to_fix"),
        F.round(F.count_if(fixed) / F.greatest(F.lit(1.0), F.datediff(F.max("o_orderdate"), F.min("o_orderdate")) / F.lit(7.0)), 4).alias("velocity"),
    )


@query("""
SELECT CASE WHEN l_returnflag = 'R' THEN 'false_positive' WHEN l_linestatus = 'F' THEN 'resolved' ELSE 'active' END AS status, count(*) AS n FROM lineitem GROUP BY 1
""")
def status_distribution(spark, sf_dir):
    status = F.when(F.col("l_returnflag") == "R", "false_positive").when(F.col("l_linestatus") == "F", "resolved").otherwise("active")
    return table(spark, sf_dir, "lineitem").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("""
SELECT split_part(p_type, ' ', 1) AS category, count(*) AS n, round(avg(p_retailprice), 4) AS mean FROM part GROUP BY 1 ORDER BY n DESC, category LIMIT 10
""")
def top_types(spark, sf_dir):
    """Top ten of a category that is the prefix of a title."""
    p = table(spark, sf_dir, "part").groupBy(F.substring_index("p_type", " ", 1).alias("category")).agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("mean"))
    return p.orderBy(F.col("n").desc(), "category").limit(10)


@query(f"""
SELECT l_suppkey AS rule_id, count(*) AS detections, count(*) FILTER (l_returnflag = 'R') AS fp, count(*) FILTER (l_returnflag = 'A') AS tp, max(l_shipdate) AS last_seen,
  count(*) FILTER (l_returnflag = 'A') / nullif(count(*) FILTER (l_returnflag IN ('A', 'R')), 0) AS precision_,
  coalesce(count(*) FILTER (l_returnflag = 'A') / nullif(count(*) FILTER (l_returnflag IN ('A', 'R')), 0), 1.0) < 0.5 OR count(*) FILTER ({_SEV} = 'critical') > 100 AS needs_refinement
FROM lineitem GROUP BY l_suppkey HAVING count(*) >= 100
""")
def rule_stats_having(spark, sf_dir):
    """Statistics per rule; precision is null without feedback; a flag over aliases; a condition on the aggregate."""
    l = _findings(spark, sf_dir)
    tp, fp = F.count_if(F.col("l_returnflag") == "A"), F.count_if(F.col("l_returnflag") == "R")
    g = l.groupBy(F.col("l_suppkey").alias("rule_id")).agg(F.count("*").alias("detections"), fp.alias("fp"), tp.alias("tp"), F.max("l_shipdate").alias("last_seen"), F.count_if(F.col("severity") == "critical").alias("c"))
    g = g.where("detections >= 100").withColumn("precision_", F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")))
    return g.withColumn("needs_refinement", (F.coalesce("precision_", F.lit(1.0)) < 0.5) | (F.col("c") > 100)).drop("c")


@query(f"""
SELECT {_SEV} AS severity, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1 ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC
""")
def severity_breakdown(spark, sf_dir):
    """By rank, not by text."""
    return _findings(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total")).orderBy(S.rank(F.col("severity")).desc())


@query("""
SELECT q.quality, q.toxic, count(*) AS n, round(avg(d.n_chars), 4) AS mean_chars FROM labels q JOIN documents d USING (doc_id) GROUP BY 1, 2
""")
def feedback_breakdown(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return table(spark, sf_dir, "labels").join(d, "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


@query("""
WITH j AS (SELECT o_orderkey AS job, epoch(o_orderdate) AS a, epoch(o_orderdate) + 86400 * 3 AS b FROM orders), r AS (SELECT event_id, epoch(ts) - epoch(TIMESTAMP '2024-01-01') + epoch(TIMESTAMP '1995-01-01') AS x FROM events)
SELECT job, count(*) AS n FROM j JOIN r ON x >= a AND x <= b GROUP BY job
""")
def interval_join_jobs(spark, sf_dir):
    """Rows that fall into the interval of a job, as an equi-join on buckets of a day."""
    return _jobs(table(spark, sf_dir, "orders"), table(spark, sf_dir, "events"))


@query(SQL["interval_join_jobs"])
def interval_join_jobs_whole(spark, sf_dir):
    """interval_join_jobs of every job."""
    return _jobs(table(spark, sf_dir, "orders"), table(spark, sf_dir, "events"))


def _jobs(orders, events):
    sec = lambda c: F.unix_timestamp(F.col(c).cast("timestamp")).cast("double")
    j = orders.select(F.col("o_orderkey").alias("job"), sec("o_orderdate").alias("a"), (sec("o_orderdate") + 86400 * 3).alias("b"))
    micro = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at")
    r = events.select("event_id", (micro - 1704067200 + 788918400).alias("at"))
    # jobs of one interval are asked once, events of one moment counted once: the rows joined do not grow with both tables
    moments, spans = r.groupBy("at").agg(F.count("*").alias("c")), j.select("a", "b").distinct()
    n = R.interval_join(moments, spans, "at", "a", "b", 86400).groupBy("a", "b").agg(F.sum("c").alias("n"))
    return j.join(n, ["a", "b"]).groupBy("job").agg(F.sum("n").alias("n"))


@query(f"""
SELECT l_orderkey, l_linenumber, {_SEV} AS severity, o_orderstatus, c_name, p_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey LEFT JOIN part ON p_partkey = l_partkey AND p_size > 25
WHERE l_returnflag <> 'R' ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, l_shipdate DESC, l_orderkey, l_linenumber LIMIT 50 OFFSET 50
""")
def findings_feed_page(spark, sf_dir):
    """Joined findings, page 2 of 50. The page is cut before the joins that only add columns."""
    l = _findings(spark, sf_dir).where("l_returnflag <> 'R'")
    o, c, p = (table(spark, sf_dir, t) for t in ("orders", "customer", "part"))
    top = R.page(l.join(o, l["l_orderkey"] == o["o_orderkey"]), [S.rank(F.col("severity")).desc(), F.col("l_shipdate").desc(), F.col("l_orderkey"), F.col("l_linenumber")], 2, 50)
    p = p.where("p_size > 25").select("p_partkey", "p_name")
    out = top.join(c, top["o_custkey"] == c["c_custkey"]).join(p, top["l_partkey"] == p["p_partkey"], "left")
    return out.select("l_orderkey", "l_linenumber", "severity", "o_orderstatus", "c_name", "p_name")


@query("""
SELECT o_orderkey, o_orderdate, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS findings, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O') AS open FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 40
""")
def commits_page_with_subcounts(spark, sf_dir):
    """Correlated counts as one aggregate over the rows of the page's 40 keys, which are few enough to send along."""
    top = R.page(table(spark, sf_dir, "orders"), [F.col("o_orderdate").desc(), F.col("o_orderkey")], 1, 40).select("o_orderkey", "o_orderdate")
    l = table(spark, sf_dir, "lineitem").join(F.broadcast(top.select("o_orderkey")), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    n = l.groupBy("l_orderkey").agg(F.count("*").alias("findings"), F.count_if(F.col("l_linestatus") == "O").alias("open"))
    return top.join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "o_orderdate", F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("open", F.lit(0)).alias("open"))


@query("""
SELECT o_custkey, o_orderkey, rn::INTEGER AS rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 10
""")
def topk_per_group(spark, sf_dir):
    return R.top_per(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 10, "rn").select("o_custkey", "o_orderkey", "rn")


@query("""
SELECT conv_id, arg_max(role, turn) AS role, max(turn) AS turn, count(*) AS turns FROM conversations GROUP BY conv_id
""")
def latest_per_entity(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max_by("role", "turn").alias("role"), F.max("turn").alias("turn"), F.count("*").alias("turns"))


@query("""
SELECT conv_id, turn, row_number() OVER w AS ordinal, lag(role) OVER w || ' -> ' || role AS transition FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
""")
def status_transitions(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(w).cast("long").alias("ordinal"), F.concat(F.lag("role").over(w), F.lit(" -> "), "role").alias("transition"))


@query("""
SELECT l_partkey, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_orderkey DESC, l_linenumber DESC) AS rn FROM lineitem WHERE l_returnflag <> 'N') WHERE rn = 1
UNION ALL SELECT l_partkey, l_orderkey FROM lineitem WHERE l_returnflag = 'N'
""")
def sca_dedupe_newest(spark, sf_dir):
    """Newest row per (package, id); rows without an id all stay."""
    l = table(spark, sf_dir, "lineitem")
    key = F.when(F.col("l_returnflag") != "N", F.concat_ws(":", F.col("l_partkey").cast("string"), "l_returnflag"))
    return R.newest_with_key(l, key, [F.col("l_orderkey").desc(), F.col("l_linenumber").desc()]).select("l_partkey", "l_orderkey")


@query("""
SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, CAST(grouping(l_returnflag, l_linestatus, l_linenumber) AS BIGINT) AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_linenumber))
""")
def grouping_sets_summary(spark, sf_dir):
    """Three group-bys in one pass."""
    l = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber")
    return l.groupingSets([["l_returnflag"], ["l_linestatus"], ["l_linenumber"]], "l_returnflag", "l_linestatus", "l_linenumber").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))


@query(f"""
SELECT l_returnflag AS scan_type, {_SEV} AS severity, count(*) AS n FROM lineitem GROUP BY ROLLUP (1, 2)
""")
def rollup_summary(spark, sf_dir):
    return _findings(spark, sf_dir).rollup(F.col("l_returnflag").alias("scan_type"), "severity").agg(F.count("*").alias("n"))


@query(f"""
SELECT l_orderkey, sum(CASE {_SEV} WHEN 'critical' THEN 10 WHEN 'high' THEN 7 WHEN 'medium' THEN 4 ELSE 1 END)::BIGINT AS score, string_agg(DISTINCT {_SEV}, ',' ORDER BY {_SEV}) AS severities, max(l_extendedprice) AS top
FROM lineitem GROUP BY l_orderkey
""")
def report_risk(spark, sf_dir):
    g = _findings(spark, sf_dir).groupBy("l_orderkey")
    return g.agg(F.sum(S.weight(F.col("severity"))).alias("score"), F.array_join(F.sort_array(F.collect_set("severity")), ",").alias("severities"), F.max("l_extendedprice").alias("top"))


@query("""
WITH o AS (SELECT s_suppkey AS id, s_name, s_nationkey, round(s_acctbal) AS b FROM supplier WHERE s_suppkey % 7 <> 0), n AS (SELECT s_suppkey AS id, s_name, CASE WHEN s_suppkey % 5 = 0 THEN s_nationkey + 1 ELSE s_nationkey END AS s_nationkey, round(s_acctbal) + CASE WHEN s_suppkey % 10 = 0 THEN 1 ELSE 0 END AS b FROM supplier WHERE s_suppkey % 11 <> 0)
SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.s_nationkey IS DISTINCT FROM n.s_nationkey OR o.b IS DISTINCT FROM n.b OR o.s_name IS DISTINCT FROM n.s_name THEN 'modified' ELSE 'unchanged' END AS status,
  CASE WHEN o.id IS NULL OR n.id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN o.s_name IS DISTINCT FROM n.s_name THEN 's_name' END, CASE WHEN o.s_nationkey IS DISTINCT FROM n.s_nationkey THEN 's_nationkey' END, CASE WHEN o.b IS DISTINCT FROM n.b THEN 'b' END) END AS changed
FROM o FULL JOIN n ON o.id = n.id
""")
def snapshot_diff(spark, sf_dir):
    """Full-outer diff of two snapshots with the fields that changed."""
    s = table(spark, sf_dir, "supplier")
    old = s.where("s_suppkey % 7 <> 0").selectExpr("s_suppkey id", "s_name", "s_nationkey", "round(s_acctbal) b")
    new = s.where("s_suppkey % 11 <> 0").selectExpr("s_suppkey id", "s_name", "CASE WHEN s_suppkey % 5 = 0 THEN s_nationkey + 1 ELSE s_nationkey END s_nationkey", "round(s_acctbal) + CASE WHEN s_suppkey % 10 = 0 THEN 1 ELSE 0 END b")
    return R.diff(old, new, "id", ["s_name", "s_nationkey", "b"])


@query("""
WITH o AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'), n AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'),
a AS (SELECT o_custkey AS k, list(DISTINCT o_orderpriority) AS c FROM orders GROUP BY 1)
SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN 'new' WHEN n.k IS NULL THEN 'resolved' WHEN list_has_any(a.c, ['1-URGENT']) THEN 'modified' ELSE 'existing' END AS status FROM o FULL JOIN n ON o.k = n.k JOIN a ON a.k = coalesce(o.k, n.k)
""")
def threat_lifecycle(spark, sf_dir):
    """Old and new sets reconciled by id; those that touch an affected component are modified."""
    o = table(spark, sf_dir, "orders")
    cut = F.expr("timestamp_ntz '1996-01-01 00:00:00'")
    g = o.groupBy(F.col("o_custkey").alias("k")).agg(F.bool_or(F.col("o_orderdate") < cut).alias("old"), F.bool_or(F.col("o_orderdate") >= cut).alias("new"), F.collect_set("o_orderpriority").alias("c"))
    return g.select("k", F.when(~F.col("old"), "new").when(~F.col("new"), "resolved").when(F.arrays_overlap("c", F.array(F.lit("1-URGENT"))), "modified").otherwise("existing").alias("status"))


@query("""
SELECT p_brand, bool_or(p_size > 45) AS exploited, arg_max(p_name, length(p_name) * 1000000 - p_partkey) AS longest, string_agg(DISTINCT split_part(p_type, ' ', 1), ',' ORDER BY split_part(p_type, ' ', 1)) AS sources, arg_min(p_retailprice, p_partkey) AS first_score FROM part GROUP BY p_brand
""")
def threat_merge(spark, sf_dir):
    """Rows of several sources merged by key: flags or-ed, first score, longest text, distinct sources."""
    p = table(spark, sf_dir, "part")
    return p.groupBy("p_brand").agg(
        F.bool_or(F.col("p_size") > 45).alias("exploited"), F.max_by("p_name", F.struct(F.length("p_name"), -F.col("p_partkey"))).alias("longest"),
        F.array_join(F.sort_array(F.collect_set(F.substring_index("p_type", " ", 1))), ",").alias("sources"), F.min_by("p_retailprice", "p_partkey").alias("first_score"),
    )


@query("""
WITH m AS (SELECT s_suppkey, p_partkey, 1 AS o FROM supplier JOIN part ON p_size = s_nationkey UNION ALL SELECT s_suppkey, p_partkey, 2 FROM supplier JOIN part ON p_size = s_nationkey + 25 AND p_partkey % 3 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY o, p_partkey) AS rn, count(*) OVER (PARTITION BY s_suppkey) - 1 AS others FROM m)
SELECT s_suppkey, p_partkey, o AS tier, others FROM r WHERE rn = 1
""")
def best_match(spark, sf_dir):
    """Tiers of equi-joins in order of strength; the best per key and how many others there were.

    Candidates are reduced to the least and a count per join key first, so a key joins one row per tier.
    """
    s, p = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), table(spark, sf_dir, "part")
    least = lambda rows: rows.groupBy("p_size").agg(F.min("p_partkey").alias("p_partkey"), F.count("*").alias("n"))
    a, b = least(p), least(p.where("p_partkey % 3 = 0"))
    tiers = [s.join(t, t["p_size"] == s["s_nationkey"] + more).select("s_suppkey", "p_partkey", F.lit(i).alias("tier"), "n") for i, (t, more) in enumerate(((a, 0), (b, 25)), 1)]
    return tiers[0].union(tiers[1]).groupBy("s_suppkey").agg(F.min(F.struct("tier", "p_partkey")).alias("m"), (F.sum("n") - 1).alias("others")).select("s_suppkey", "m.p_partkey", "m.tier", "others")


@query("""
SELECT n_name AS sector, count(c_custkey) AS projects, round(avg(coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal / 10000 END, 0.7)), 9) AS effectiveness FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name
""")
def coverage_matrix(spark, sf_dir):
    """Groups without members stay; a missing effectiveness counts as 0.7."""
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    e = F.coalesce(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 10000), F.lit(0.7))
    return n.join(c, n["n_nationkey"] == c["c_nationkey"], "left").groupBy(F.col("n_name").alias("sector")).agg(F.count("c_custkey").alias("projects"), F.round(F.avg(e), 9).alias("effectiveness"))


@query("""
WITH l AS (SELECT l_partkey, l_quantity AS freq, l_extendedprice AS loss, l_discount AS d FROM lineitem),
t AS (SELECT l_partkey, freq * 0.5 AS f0, freq AS f1, freq * 2 AS f2, loss * (1 - d) AS m FROM l)
SELECT l_partkey % 7 AS category, round(sum(f0 * m), 2) AS ale_min, round(sum(f1 * m), 2) AS ale_likely, round(sum((f0 + 4 * f1 + f2) / 6 * m), 2) AS ale_pert FROM t GROUP BY 1
""")
def fair_risk(spark, sf_dir):
    """Loss frequency times magnitude at three points, summed by loss category."""
    l = table(spark, sf_dir, "lineitem")
    m = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    q = F.col("l_quantity")
    return l.groupBy((F.col("l_partkey") % 7).alias("category")).agg(F.round(F.sum(q * 0.5 * m), 2).alias("ale_min"), F.round(F.sum(q * m), 2).alias("ale_likely"), F.round(F.sum((q * 0.5 + 4 * q + q * 2) / 6 * m), 2).alias("ale_pert"))


@query(f"""
WITH p AS (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8, 9]) AS phase), f AS (SELECT l_linenumber AS phase, {_SEV} AS severity FROM lineitem),
g AS (SELECT p.phase, count(severity) AS n, count(*) FILTER (severity = 'critical') AS critical FROM p LEFT JOIN f USING (phase) GROUP BY 1)
SELECT phase, n, critical, n = 0 AS gap, round(100.0 * n / (SELECT sum(n) FROM g), 4) AS share, phase = (SELECT arg_max(phase, n * 100 - phase) FROM g) AS busiest FROM g
""")
def kill_chain_rollup(spark, sf_dir):
    """Counts per phase over the full list of phases, gaps, shares and the busiest phase."""
    f = _findings(spark, sf_dir).groupBy(F.col("l_linenumber").alias("phase")).agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "critical").alias("critical"))
    g = spark.range(1, 10).select(F.col("id").cast("int").alias("phase")).join(f, "phase", "left").na.fill(0)
    total = g.agg(F.sum("n").alias("t"), F.max_by("phase", F.col("n") * 100 - F.col("phase")).alias("top"))
    return g.crossJoin(total.hint("broadcast")).select("phase", "n", "critical", (F.col("n") == 0).alias("gap"), F.round(100.0 * F.col("n") / F.col("t"), 4).alias("share"), (F.col("phase") == F.col("top")).alias("busiest"))
