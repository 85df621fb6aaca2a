"""Lists, filters, sorts and reports over findings; the tables stand in as in ``dashboards``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import correlation
from .registry import query, table

_SEV = "CASE WHEN l_quantity >= 45 THEN 'critical' WHEN l_quantity >= 30 THEN 'high' WHEN l_quantity >= 15 THEN 'medium' ELSE 'low' END"
_RANK = f"CASE {_SEV} WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 100 WHEN o_orderstatus = 'P' THEN 50 ELSE 0 END AS progress FROM orders")
def progress_projection(spark, sf_dir):
    """Progress that follows from a status."""
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderstatus = 'F' THEN 100 WHEN o_orderstatus = 'P' THEN 50 ELSE 0 END AS progress")


@query("""
SELECT p_partkey, p_type, p_brand FROM part WHERE p_size > 10 AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') ORDER BY p_type DESC, p_partkey LIMIT 40
""")
def rules_by_lexical_severity(spark, sf_dir):
    """Optional filters and an order by the label as text, not by its rank, as the rule list has it."""
    p = table(spark, sf_dir, "part").where("p_size > 10").where(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3"))
    return p.orderBy(F.col("p_type").desc(), "p_partkey").select("p_partkey", "p_type", "p_brand").limit(40)


@query("""
SELECT doc_id, source, lang FROM documents WHERE (strpos(lower(text), 'license') > 0 OR strpos(lower(source), 'license') > 0) AND lang IN ('en', 'de') AND source <> 'src1'
""")
def text_severity_source_filters(spark, sf_dir):
    """Case-insensitive text search in two columns with two further filters."""
    d = table(spark, sf_dir, "documents")
    hit = F.lower("text").contains("license") | F.lower("source").contains("license")
    return d.where(hit & F.col("lang").isin("en", "de") & (F.col("source") != "src1")).select("doc_id", "source", "lang")


@query(f"""
SELECT l_orderkey, l_linenumber, l_partkey, {_SEV} AS severity, l_discount FROM lineitem WHERE l_linestatus = 'O' ORDER BY {_RANK} DESC, l_discount DESC, l_orderkey, l_linenumber, l_partkey LIMIT 100
""")
def suggestions_sorted(spark, sf_dir):
    """Filters, then the rank of the severity and the confidence, both descending."""
    l = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'")
    top = l.orderBy(F.expr(_RANK).desc(), F.col("l_discount").desc(), "l_orderkey", "l_linenumber", "l_partkey").limit(100)
    return top.select("l_orderkey", "l_linenumber", "l_partkey", F.expr(_SEV).alias("severity"), "l_discount")


@query("""
SELECT l_suppkey, tp, fp, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) END AS "precision" FROM (
  SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R' AND l_quantity > 49) AS tp, count(*) FILTER (l_returnflag = 'A' AND l_quantity > 49) AS fp FROM lineitem GROUP BY 1)
ORDER BY coalesce(CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) END, 1.0) DESC, l_suppkey LIMIT 30
""")
def rules_by_precision_nulls_first(spark, sf_dir):
    """Rules without any verdict sort as if their precision were 1."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.expr("l_returnflag = 'R' AND l_quantity > 49")).alias("tp"), F.count_if(F.expr("l_returnflag = 'A' AND l_quantity > 49")).alias("fp"))
    out = l.withColumn("precision", F.expr("CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) END"))
    return out.orderBy(F.coalesce("precision", F.lit(1.0)).desc(), "l_suppkey").limit(30)


@query("""
SELECT c_custkey, urgent, failed FROM (SELECT o_custkey AS c_custkey, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderstatus = 'F') AS failed FROM orders GROUP BY 1)
ORDER BY urgent + failed DESC, c_custkey LIMIT 20
""")
def repos_by_summed_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.count_if(F.col("o_orderstatus") == "F").alias("failed"))
    return o.orderBy((F.col("urgent") + F.col("failed")).desc(), "c_custkey").limit(20)


@query("""
SELECT event_id, user_id % 5 = 0 AS exploited, event_type, value FROM events
ORDER BY user_id % 5 = 0 DESC, CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END DESC, value DESC, event_id LIMIT 50
""")
def threats_by_tuple(spark, sf_dir):
    """Exploited first, then severity, then score; the page alone is sorted globally."""
    e = table(spark, sf_dir, "events").withColumn("exploited", F.col("user_id") % 5 == 0)
    rank = F.expr("CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END")
    return e.orderBy(F.col("exploited").desc(), rank.desc(), F.col("value").desc(), "event_id").limit(50).select("event_id", "exploited", "event_type", "value")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'R' ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 1000")
def vulnerabilities_capped(spark, sf_dir):
    """The row cap of the list, made deterministic by an order."""
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey").orderBy("l_orderkey", "l_linenumber", "l_partkey").limit(1000)


@query("""
WITH e AS (SELECT event_type, CASE WHEN value >= 50 THEN 'high' ELSE 'low' END AS severity, unnest(CASE WHEN user_id % 2 = 0 THEN ['kev', 'nvd'] ELSE ['otx'] END) AS source FROM events)
SELECT 'severity' AS kind, severity AS name, count(*) AS n FROM (SELECT CASE WHEN value >= 50 THEN 'high' ELSE 'low' END AS severity FROM events) GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM e GROUP BY 2
""")
def intel_stats(spark, sf_dir):
    """Counts by severity and, sources exploded, by source; events are first counted by what both need."""
    e = table(spark, sf_dir, "events").groupBy(F.expr("CASE WHEN value >= 50 THEN 'high' ELSE 'low' END").alias("severity"), (F.col("user_id") % 2 == 0).alias("even")).agg(F.count("*").alias("n"))
    by_source = e.select(F.explode(F.when(F.col("even"), F.array(F.lit("kev"), F.lit("nvd"))).otherwise(F.array(F.lit("otx")))).alias("name"), "n")
    both = e.select(F.lit("severity").alias("kind"), F.col("severity").alias("name"), "n").union(by_source.select(F.lit("source"), "name", "n"))
    return both.groupBy("kind", "name").agg(F.sum("n").alias("n"))


@query(f"""
SELECT p_brand AS cwe, {_SEV} AS severity, count(*) AS n, count(DISTINCT l_orderkey) AS files, max(l_extendedprice) AS worst FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2
""")
def findings_by_cwe(spark, sf_dir):
    """The sheet of findings per weakness and severity: counts, files, the worst."""
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    j = l.join(p, l["l_partkey"] == p["p_partkey"])
    return j.groupBy(F.col("p_brand").alias("cwe"), F.expr(_SEV).alias("severity")).agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("files"), F.max("l_extendedprice").alias("worst"))


@query("""
SELECT l_partkey, count(*) AS n, string_agg(l_orderkey::VARCHAR || ':' || l_linenumber::VARCHAR, ' ' ORDER BY l_orderkey, l_linenumber) AS findings FROM lineitem WHERE l_quantity >= 45 GROUP BY 1
""")
def findings_by_package(spark, sf_dir):
    """Per package the list of its critical findings, in order."""
    l = table(spark, sf_dir, "lineitem").where("l_quantity >= 45").groupBy("l_partkey").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber"))).alias("x"))
    return l.select("l_partkey", "n", F.array_join(F.transform("x", lambda r: F.concat_ws(":", r.l_orderkey, r.l_linenumber)), " ").alias("findings"))


@query("""
SELECT p_type AS severity, p_brand AS category, p_size % 4 AS framework, count(*) AS n, round(avg(p_retailprice), 4) AS mean FROM part GROUP BY GROUPING SETS ((p_type), (p_brand), (p_size % 4), ())
""")
def suggestion_stats(spark, sf_dir):
    """Counts and a mean by severity, category, framework and over all, in one pass."""
    p = table(spark, sf_dir, "part").select(F.col("p_type").alias("severity"), F.col("p_brand").alias("category"), (F.col("p_size") % 4).alias("framework"), "p_retailprice")
    sets = [["severity"], ["category"], ["framework"], []]
    return p.groupingSets(sets, "severity", "category", "framework").agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("mean"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def findings_cube(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("""
SELECT count(*) AS total, count(*) FILTER (s = 'used') AS reachable, count(*) FILTER (s = 'imported') AS imported, count(*) FILTER (s = 'absent') AS not_imported,
  round(100.0 * count(*) FILTER (s <> 'absent') / greatest(count(*), 1), 4) AS coverage
FROM (SELECT CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) THEN 'used' WHEN p_partkey IN (SELECT l_partkey FROM lineitem) THEN 'imported' ELSE 'absent' END AS s FROM part)
""")
def reachability_summary(spark, sf_dir):
    """Packages used, imported or not, and their coverage; usage is aggregated per package before the join."""
    used = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.max("l_quantity").alias("q"))
    p = table(spark, sf_dir, "part").join(used, F.col("p_partkey") == F.col("l_partkey"), "left")
    s = F.when(F.col("q") > 45, "used").when(F.col("q").isNotNull(), "imported").otherwise("absent")
    n = lambda c: F.count_if(F.col("s") == c)
    return p.select(s.alias("s")).agg(
        F.count("*").alias("total"), n("used").alias("reachable"), n("imported").alias("imported"), n("absent").alias("not_imported"),
        F.round(F.lit(100.0) * F.count_if(F.col("s") != "absent") / F.greatest(F.count("*"), F.lit(1)), 4).alias("coverage"),
    )


@query("""
SELECT name, count(*) AS files, CAST(sum(n) AS BIGINT) AS findings FROM (SELECT 'a' AS f, l_partkey AS name, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 2
  UNION ALL SELECT 'r', l_partkey, count(*) FROM lineitem WHERE l_returnflag = 'R' GROUP BY 2) GROUP BY name
""")
def multi_file_combine(spark, sf_dir):
    """Results of several manifests united and grouped by package."""
    l = table(spark, sf_dir, "lineitem")
    parts = [l.where(f"l_returnflag = '{f}'").groupBy(F.col("l_partkey").alias("name")).agg(F.count("*").alias("n")) for f in ("A", "R")]
    return parts[0].union(parts[1]).groupBy("name").agg(F.count("*").alias("files"), F.sum("n").alias("findings"))


@query("""
SELECT status, count(*) AS n FROM (SELECT CASE WHEN a.o_custkey IS NULL THEN 'new' WHEN b.o_custkey IS NULL THEN 'resolved' WHEN a.p <> b.p THEN 'modified' ELSE 'existing' END AS status
  FROM (SELECT o_custkey, max(o_orderpriority) AS p FROM orders WHERE o_orderdate < DATE '1996-01-01' GROUP BY 1) a FULL JOIN (SELECT o_custkey, max(o_orderpriority) AS p FROM orders WHERE o_orderdate >= DATE '1996-01-01' GROUP BY 1) b ON a.o_custkey = b.o_custkey) GROUP BY 1
""")
def threat_lifecycle_counts(spark, sf_dir):
    """Old and new state of each threat from one aggregate over both periods, then counts by status."""
    old = F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp")
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.when(old, F.col("o_orderpriority"))).alias("a"), F.max(F.when(~old, F.col("o_orderpriority"))).alias("b"))
    status = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "resolved").when(F.col("a") != F.col("b"), "modified").otherwise("existing")
    return o.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("""
SELECT o_custkey, count(*) AS scans, max(o_orderdate) AS latest, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1
""")
def scans_by_project(spark, sf_dir):
    """Totals and the latest scan of each project."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("scans"), F.max("o_orderdate").alias("latest"), F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
SELECT s_nationkey, arg_max(k, (loss, k)) AS dominant, CASE arg_max(k, (loss, k)) WHEN 'response' THEN 'Prepare incident response' WHEN 'fines' THEN 'Review compliance' ELSE 'Harden production' END AS recommendation
FROM (SELECT s_nationkey, ['response', 'fines', 'productivity'][1 + s_suppkey % 3] AS k, round(sum(abs(s_acctbal)), 2) AS loss FROM supplier GROUP BY 1, 2) GROUP BY 1
""")
def fair_recommendations(spark, sf_dir):
    """Per sector the loss category with the largest sum, and the advice that goes with it."""
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey", F.expr("element_at(array('response', 'fines', 'productivity'), cast(1 + s_suppkey % 3 AS int))").alias("k")).agg(F.round(F.sum(F.abs("s_acctbal")), 2).alias("loss"))
    top = s.groupBy("s_nationkey").agg(F.max_by("k", F.struct("loss", "k")).alias("dominant"))
    return top.withColumn("recommendation", F.when(F.col("dominant") == "response", "Prepare incident response").when(F.col("dominant") == "fines", "Review compliance").otherwise("Harden production"))



@query("""
SELECT l_partkey, l_suppkey, min(phase) AS phase, arg_min(l_orderkey, (phase, l_orderkey)) AS first FROM (
  SELECT 1 AS phase, * FROM lineitem WHERE l_quantity > 45 UNION ALL SELECT 2, * FROM lineitem WHERE l_discount >= 0.08 UNION ALL SELECT 3, * FROM lineitem WHERE l_tax >= 0.07
  UNION ALL SELECT 4, * FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 5, * FROM lineitem WHERE l_linenumber = 1) GROUP BY 1, 2
""")
def five_phase_union(spark, sf_dir):
    """Five detectors, of each (file, weakness) the finding of the earliest phase: one scan, no union."""
    conditions = ("l_quantity > 45", "l_discount >= 0.08", "l_tax >= 0.07", "l_returnflag = 'R'", "l_linenumber = 1")
    phase = F.coalesce(*[F.when(F.expr(c), F.lit(i)) for i, c in enumerate(conditions, 1)])
    l = table(spark, sf_dir, "lineitem").withColumn("phase", phase).where("phase is not null")
    return l.groupBy("l_partkey", "l_suppkey").agg(F.min("phase").alias("phase"), F.min_by("l_orderkey", F.struct("phase", "l_orderkey")).alias("first"))


@query("""
SELECT p_partkey, 'static' AS origin FROM part WHERE p_size <= 25 UNION ALL
SELECT DISTINCT l_partkey, 'live' FROM lineitem WHERE l_quantity >= 49 AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)
""")
def static_and_live_advisories(spark, sf_dir):
    """The static list and what the live feed has beyond it."""
    static = table(spark, sf_dir, "part").where("p_size <= 25").select("p_partkey", F.lit("static").alias("origin"))
    live = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return static.union(live.join(static, "p_partkey", "left_anti").select("p_partkey", F.lit("live")))


@query("SELECT p_name, arg_max(p_brand, p_partkey) AS version, count(*) AS seen FROM part GROUP BY 1")
def package_versions_last_wins(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_name").agg(F.max_by("p_brand", "p_partkey").alias("version"), F.count("*").alias("seen"))


@query("""
WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_shipdate >= DATE '1998-01-01' GROUP BY 1), f AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT p_partkey, CASE WHEN c.n IS NULL THEN 'miss' ELSE 'hit' END AS cache, coalesce(c.n, f.n, 0) AS n FROM part LEFT JOIN c ON c.l_partkey = p_partkey LEFT JOIN f ON f.l_partkey = p_partkey
""")
def batch_with_cache(spark, sf_dir):
    """Fresh cache entries answer; only the misses are looked up."""
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey")
    cache = l.where("l_shipdate >= DATE '1998-01-01'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    miss = p.join(cache, "p_partkey", "left_anti")
    looked = miss.join(l.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n")), "p_partkey", "left")
    hits = p.join(cache, "p_partkey").select("p_partkey", F.lit("hit").alias("cache"), "n")
    return hits.union(looked.select("p_partkey", F.lit("miss"), F.coalesce("n", F.lit(0)).alias("n")))


@query("""
SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_event, arg_max(event_type, (ts, event_id)) = 'error' AS deleted, count(*) FILTER (event_type = 'error') AS flips FROM events GROUP BY 1
""")
def status_from_events(spark, sf_dir):
    """Soft deletion: the state of an item is its latest event."""
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(last.alias("last_event"), (last == "error").alias("deleted"), F.count_if(F.col("event_type") == "error").alias("flips"))


@query("""
WITH g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events))
SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, s
""")
def sessions(spark, sf_dir):
    """Sessions with a gap of 30 minutes."""
    e = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT c_custkey, c_name, o.n AS scans FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey = 7 GROUP BY 1) o ON o_custkey = c_custkey WHERE c_custkey = 7")
def lookup_by_key(spark, sf_dir):
    """One key: the filter reaches both scans."""
    o = table(spark, sf_dir, "orders").where("o_custkey = 7").groupBy("o_custkey").agg(F.count("*").alias("scans"))
    return table(spark, sf_dir, "customer").where("c_custkey = 7").join(o, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name", "scans")


@query("""
SELECT p_brand, p_partkey, p_retailprice, r FROM (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 3
""")
def top_three_per_pair(spark, sf_dir):
    w = Window.partitionBy("p_brand").orderBy(F.col("p_retailprice").desc(), "p_partkey")
    return table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice", F.row_number().over(w).alias("r")).where("r <= 3")


@query("""
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 > 0 THEN o_custkey END AS a, CASE WHEN o_orderkey % 13 > 0 THEN CAST(o_orderdate AS DATE) END AS b FROM orders
), r AS (SELECT list_reduce(list({'o': o_orderkey, 'a': a, 'b': b} ORDER BY o_orderkey), lambda acc, x: CASE WHEN coalesce(list_contains(acc.a, x.a), false) OR coalesce(list_contains(acc.b, x.b), false) THEN acc
  ELSE {'kept': list_append(acc.kept, x.o), 'a': CASE WHEN x.a IS NULL THEN acc.a ELSE list_append(acc.a, x.a) END, 'b': CASE WHEN x.b IS NULL THEN acc.b ELSE list_append(acc.b, x.b) END} END,
  {'kept': CAST([] AS BIGINT[]), 'a': CAST([] AS BIGINT[]), 'b': CAST([] AS DATE[])}) AS acc FROM o)
SELECT o.* FROM o WHERE o_orderkey IN (SELECT unnest(acc.kept) FROM r)
""")
def greedy_two_key_dedup(spark, sf_dir):
    """Findings in order, each kept unless one kept before has its package key or its title key."""
    o = table(spark, sf_dir, "orders")
    o = o.select("o_orderkey", F.when(F.col("o_orderkey") % 11 > 0, F.col("o_custkey")).alias("a"), F.when(F.col("o_orderkey") % 13 > 0, F.to_date("o_orderdate")).alias("b"))
    return correlation.greedy_unique(o, "o_orderkey", "a", "b")
