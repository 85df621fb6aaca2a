"""Threat modelling, correlation and relevance, suppression and texts; parts stand for threats, orders for findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import correlation as X
from ..operators import graph as G
from .dependencies import _EDGES, _edges
from .registry import query, table

_SCORES = {"cve": 100.0, "cwe": 60.0, "family": 40.0, "word": 20.0}


@query("""
WITH v AS (SELECT o_orderkey AS vid, o_custkey AS cve, CAST(o_orderkey % 60 AS INTEGER) AS cwe, 'Brand#' || (o_orderkey % 26) AS family, ['small', 'ring', 'ECONOMY', 'PROMO'] AS words FROM orders),
t AS (SELECT p_partkey AS tid, p_partkey AS cve, p_size AS cwe, p_brand AS family, string_split(p_name, ' ') AS words FROM part),
w AS (SELECT w AS word, tid, row_number() OVER (PARTITION BY w ORDER BY tid) AS pos FROM (SELECT DISTINCT tid, unnest(words) AS w FROM t)),
a AS (SELECT vid, word, row_number() OVER (PARTITION BY vid ORDER BY rank) AS r FROM (SELECT vid, unnest(words) AS word, unnest(range(4)) AS rank FROM v) WHERE word IN (SELECT word FROM w)),
m AS (SELECT vid, tid, 1 AS tier, 100.0 AS score FROM v JOIN (SELECT cve, max(tid) AS tid FROM t GROUP BY 1) USING (cve)
  UNION ALL SELECT vid, tid, 2, 60.0 FROM v JOIN (SELECT cwe, tid, row_number() OVER (PARTITION BY cwe ORDER BY tid) AS pos FROM t) USING (cwe) WHERE pos <= 5
  UNION ALL SELECT vid, tid, 3, 40.0 FROM v JOIN (SELECT family, tid, row_number() OVER (PARTITION BY family ORDER BY tid) AS pos FROM t) USING (family) WHERE pos <= 3 AND v.cwe NOT IN (SELECT cwe FROM t)
  UNION ALL SELECT vid, tid, 4, 20.0 FROM a JOIN w USING (word) WHERE r <= 3 AND pos <= 3),
u AS (SELECT vid, tid, arg_min(score, tier) AS score FROM m GROUP BY 1, 2)
SELECT vid, arg_min(tid, (-score, tid)) AS tid, CAST(max(score) AS DOUBLE) AS score, count(*) - 1 AS alternatives FROM u GROUP BY vid
""")
def four_tier_correlation(spark, sf_dir):
    """Exact key, weakness, family of weaknesses, words; the best match and how many others there were."""
    words = F.array(*[F.lit(w) for w in ("small", "ring", "ECONOMY", "PROMO")])
    v = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("vid"), F.col("o_custkey").alias("cve"), (F.col("o_orderkey") % 60).cast("int").alias("cwe"), F.concat(F.lit("Brand#"), F.col("o_orderkey") % 26).alias("family"), words.alias("words"))
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tid"), F.col("p_partkey").alias("cve"), F.col("p_size").alias("cwe"), F.col("p_brand").alias("family"), F.split("p_name", " ").alias("words"))
    return X.best_match(X.tiers(v, t, _SCORES))


@query("""
WITH c AS (SELECT s_suppkey AS cid, s_nationkey % 5 AS category, ['small', 'ring', CAST(s_suppkey AS VARCHAR), 'steel'] AS words FROM supplier),
t AS (SELECT p_partkey AS tid, p_size % 50 AS category, list_distinct(string_split(p_name, ' ')) AS words FROM part)
SELECT cid, tid, score FROM (SELECT cid, tid, round((c.category = t.category)::INTEGER * 0.5::DOUBLE + least(len(list_intersect(c.words, t.words)) / 4 * 0.5::DOUBLE, 0.4::DOUBLE), 6) AS score FROM c, t) WHERE score >= 0.2
""")
def scored_cross_join(spark, sf_dir):
    """Controls and threats that reach a relevance of 0.2, by equi-joins on category and words; without a category there is no score."""
    c = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cid"), (F.col("s_nationkey") % 5).alias("category"), F.array(F.lit("small"), F.lit("ring"), F.col("s_suppkey").cast("string"), F.lit("steel")).alias("words"))
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tid"), (F.col("p_size") % 50).alias("category"), F.split("p_name", " ").alias("words"))
    return X.relevance(c.where("category is not null"), t.where("category is not null"), 0.2)


#: Controls of a standard (id, title) with the words of at least four letters that count.
CONTROLS = (("V2", "authentication verification"), ("V4", "access control"), ("V5", "input validation encoding"), ("V7", "error handling logging"), ("V8", "data protection"))


@query(f"""
WITH k(control, title) AS (VALUES {", ".join(map(str, CONTROLS))}), s AS (SELECT doc_id, control, round(list_sum([CASE WHEN length(w) > 3 AND contains(lower(text), left(w, 4)) THEN 0.2::DOUBLE ELSE 0 END for w in string_split(title, ' ')]), 6) AS score FROM documents, k)
SELECT doc_id, control, score FROM s WHERE score > 0.3
""")
def map_to_compliance(spark, sf_dir):
    """Requirements against the few controls of a standard, which are literals of the projection: no join."""
    text = F.lower("text")
    score = lambda title: sum((F.when(text.contains(w[:4]), F.lit(0.2)).otherwise(F.lit(0.0)) for w in title.split() if len(w) > 3), F.lit(0.0))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("control"), F.round(score(t), 6).alias("score")) for c, t in CONTROLS]))
    return table(spark, sf_dir, "documents").select("doc_id", each.alias("x")).select("doc_id", "x.control", "x.score").where("score > 0.3")


@query("""
WITH t(tech, stride, threat) AS (VALUES (0, 'spoofing', 'Forged identity'), (0, 'tampering', 'Changed data'), (1, 'information_disclosure', 'Leaked records'), (2, 'denial_of_service', 'Exhausted pool'), (3, 'elevation_of_privilege', 'Broken role check'))
SELECT s_suppkey, stride, threat || ' in ' || s_name AS title, CASE WHEN s_acctbal > 5000 THEN 'high' ELSE 'medium' END AS severity FROM supplier JOIN t ON tech = s_nationkey % 5
""")
def stride_expansion(spark, sf_dir):
    """Threats of each component by its technology, with generated titles; the catalog is a literal of five rows."""
    rows = [(0, "spoofing", "Forged identity"), (0, "tampering", "Changed data"), (1, "information_disclosure", "Leaked records"), (2, "denial_of_service", "Exhausted pool"), (3, "elevation_of_privilege", "Broken role check")]
    t = spark.createDataFrame(rows, "tech int, stride string, threat string")
    s = table(spark, sf_dir, "supplier")
    j = s.join(F.broadcast(t), s["s_nationkey"] % 5 == t["tech"])
    return j.select("s_suppkey", "stride", F.concat("threat", F.lit(" in "), "s_name").alias("title"), F.when(F.col("s_acctbal") > 5000, "high").otherwise("medium").alias("severity"))


@query(f"""
WITH RECURSIVE e AS (SELECT * FROM ({_EDGES}) WHERE src <> dst), p(start, node, depth, path) AS (SELECT n_nationkey, n_nationkey, 0, [n_nationkey] FROM nation WHERE n_nationkey < 5
  UNION ALL SELECT p.start, e.dst, p.depth + 1, list_append(p.path, e.dst) FROM p JOIN e ON e.src = p.node WHERE NOT list_contains(p.path, e.dst) AND p.depth < 4),
s AS (SELECT start, node, array_to_string(path, '>') AS path, CAST(len(path) AS INTEGER) AS hops, round(least(100.0, list_avg([x % 11 for x in path]) * 10), 6) AS risk, CAST(len(list_filter(path, lambda x: x % 11 >= 7)) AS INTEGER) AS critical FROM p WHERE depth > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY start, node ORDER BY risk DESC, path) AS rn FROM s)
SELECT start, node, path, hops, risk, CASE WHEN critical >= 2 THEN 'low' WHEN critical = 1 THEN 'medium' ELSE 'high' END AS difficulty FROM r WHERE rn <= 3
""")
def attack_path_scores(spark, sf_dir):
    """Simple paths with ten times the mean risk of their nodes (100 at most) and a difficulty; the three worst per pair."""
    from pyspark.sql import Window

    starts = table(spark, sf_dir, "nation").where("n_nationkey < 5").select(F.col("n_nationkey").alias("start"))
    p = G.simple_paths(_edges(spark, sf_dir), starts, 4)
    total = F.aggregate("path", F.lit(0).cast("long"), lambda a, x: a + x % 11)
    critical = F.size(F.filter("path", lambda x: x % 11 >= 7))
    s = p.select("start", "node", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), F.size("path").alias("hops"), F.round(F.least(F.lit(100.0), total / F.size("path") * 10), 6).alias("risk"), F.when(critical >= 2, "low").when(critical == 1, "medium").otherwise("high").alias("difficulty"))
    w = Window.partitionBy("start", "node").orderBy(F.col("risk").desc(), "path")
    return s.withColumn("rn", F.row_number().over(w)).where("rn <= 3").drop("rn")


@query(f"""
WITH RECURSIVE e AS (SELECT * FROM ({_EDGES}) WHERE src <> dst), p(start, node, depth, path) AS (SELECT n_nationkey, n_nationkey, 0, [n_nationkey] FROM nation WHERE n_nationkey < 5
  UNION ALL SELECT p.start, e.dst, p.depth + 1, list_append(p.path, e.dst) FROM p JOIN e ON e.src = p.node WHERE NOT list_contains(p.path, e.dst) AND p.depth < 5)
SELECT start, CAST(max(depth) AS INTEGER) AS max_depth, count(*) FILTER (depth > 0) AS paths FROM p GROUP BY start HAVING max(depth) > 0
""")
def call_depth(spark, sf_dir):
    """The longest simple call chain from each entry."""
    starts = table(spark, sf_dir, "nation").where("n_nationkey < 5").select(F.col("n_nationkey").alias("start"))
    return G.simple_paths(_edges(spark, sf_dir), starts, 5).groupBy("start").agg(F.max("depth").alias("max_depth"), F.count("*").alias("paths"))


@query("""
SELECT o_custkey, array_to_string(list_sort(list_distinct(list(CASE o_orderpriority WHEN '1-URGENT' THEN '5 impact' WHEN '2-HIGH' THEN '4 lateral movement' WHEN '3-MEDIUM' THEN '3 execution' ELSE '1 reconnaissance' END))), ' > ') AS kill_chain FROM orders GROUP BY 1
""")
def kill_chain_sequence(spark, sf_dir):
    """The phases that a path touches, in their order."""
    phase = F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN '5 impact' WHEN '2-HIGH' THEN '4 lateral movement' WHEN '3-MEDIUM' THEN '3 execution' ELSE '1 reconnaissance' END")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set(phase)), " > ").alias("kill_chain"))


@query("""
WITH d AS (SELECT doc_id, CASE WHEN n_chars > 4000 THEN 4 WHEN n_chars > 1500 THEN 3 WHEN n_chars > 400 THEN 2 ELSE 1 END AS idx, regexp_matches(text, '(?i)license') AS safe, source IN ('src1', 'src2') AS test, regexp_matches(text, '(?i)rights reserved') AS context, regexp_matches(text, '@') AS input FROM documents),
a AS (SELECT *, greatest(0, idx - CASE WHEN safe THEN 2 ELSE 0 END) AS i1 FROM d), b AS (SELECT *, greatest(0, i1 - CASE WHEN test THEN 2 ELSE 0 END) AS i2 FROM a),
c AS (SELECT *, greatest(0, greatest(0, i2 - CASE WHEN context THEN 1 ELSE 0 END) - CASE WHEN input THEN 0 ELSE 1 END) AS i3 FROM b)
SELECT doc_id, ['info', 'low', 'medium', 'high', 'critical'][i3 + 1] AS confidence FROM c WHERE NOT (i3 <= 1 AND (safe OR context))
""")
def shifted_confidence(spark, sf_dir):
    """Levels moved down by safe patterns, test files, safe context and missing user input; weak findings in safe places go."""
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("n_chars") > 4000, 4).when(F.col("n_chars") > 1500, 3).when(F.col("n_chars") > 400, 2).otherwise(1).alias("i"),
        F.col("text").rlike("(?i)license").alias("safe"), F.col("source").isin("src1", "src2").alias("test"), F.col("text").rlike("(?i)rights reserved").alias("context"), (~F.col("text").rlike("@")).alias("no_input"),
    )
    for flag, by in (("safe", 2), ("test", 2), ("context", 1), ("no_input", 1)):
        d = d.withColumn("i", F.greatest(F.lit(0), F.col("i") - F.when(F.col(flag), by).otherwise(0)))
    levels = F.array(*[F.lit(x) for x in ("info", "low", "medium", "high", "critical")])
    return d.where("not (i <= 1 and (safe or context))").select("doc_id", F.element_at(levels, (F.col("i") + 1).cast("int")).alias("confidence"))


@query("SELECT doc_id, CAST(strpos(text, regexp_extract(text, '[Ll]icense')) AS INTEGER) AS position FROM documents WHERE regexp_matches(text, '[Ll]icense')")
def match_position(spark, sf_dir):
    """The column (from 1) at which a pattern first matches."""
    d = table(spark, sf_dir, "documents").where(F.col("text").rlike("[Ll]icense"))
    return d.select("doc_id", F.regexp_instr("text", F.lit("[Ll]icense")).cast("int").alias("position"))


@query("""
SELECT doc_id, regexp_matches(text, '(?i)license') AND regexp_matches(text, '(?i)rights|mit') AND NOT regexp_matches(text, '(?i)gpl|apache') AS hit FROM documents
""")
def all_patterns_none_negative(spark, sf_dir):
    """A rule of several patterns: all must match, none of the negative ones."""
    need, avoid = F.array(F.lit("(?i)license"), F.lit("(?i)rights|mit")), F.array(F.lit("(?i)gpl|apache"))
    return table(spark, sf_dir, "documents").select("doc_id", (F.forall(need, lambda p: F.regexp_like("text", p)) & ~F.exists(avoid, lambda p: F.regexp_like("text", p))).alias("hit"))


@query("""
SELECT event_id, CAST(coalesce(json_extract_string(props, '$.k'), '0') AS INTEGER) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing, CAST(len(json_keys(props)) AS INTEGER) AS entries FROM events
""")
def map_with_defaults(spark, sf_dir):
    """Values of a map with defaults, and how many entries it has."""
    m = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.try_element_at(m, F.lit("k")), F.lit("0")).cast("int").alias("k"), F.coalesce(F.try_element_at(m, F.lit("missing")), F.lit("none")).alias("missing"), F.size(F.map_keys(m)).alias("entries"))


@query("""
SELECT s_suppkey, x AS threat FROM (SELECT s_suppkey, unnest(CASE WHEN s_suppkey % 2 = 0 THEN ['spoof' || s_suppkey, 'tamper' || s_suppkey] ELSE ['flat' || s_suppkey] END) AS x FROM supplier)
""")
def dict_or_list_flatten(spark, sf_dir):
    """Threats stored as a map of lists or as one list, flattened alike."""
    stored = F.when(F.col("s_suppkey") % 2 == 0, F.format_string('{"S": ["spoof%d"], "T": ["tamper%d"]}', "s_suppkey", "s_suppkey")).otherwise(F.format_string('["flat%d"]', "s_suppkey"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", stored.alias("j"))
    flat = F.when(F.left("j", F.lit(1)) == "{", F.flatten(F.map_values(F.from_json("j", "map<string,array<string>>")))).otherwise(F.from_json("j", "array<string>"))
    return s.select("s_suppkey", F.explode(flat).alias("threat"))


@query("""
SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderstatus = 'F' THEN 'status is final' END, CASE WHEN o_totalprice > 200000 THEN 'price changed' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'severity raised' END], lambda x: x IS NOT NULL), '; ') AS reason FROM orders
""")
def modification_reasons(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("; ", F.when(F.col("o_orderstatus") == "F", "status is final"), F.when(F.col("o_totalprice") > 200000, "price changed"), F.when(F.col("o_orderpriority") == "1-URGENT", "severity raised")).alias("reason"))


@query("""
SELECT p_partkey, coalesce(t.impact, 'Impact of ' || p_type || ' is unknown') AS impact FROM part LEFT JOIN (VALUES ('ECONOMY', 'Data loss'), ('PROMO', 'Account takeover')) t(kind, impact) ON kind = p_type
""")
def impact_fallback(spark, sf_dir):
    """The template of a kind of finding, else a generic text."""
    t = spark.createDataFrame([("ECONOMY", "Data loss"), ("PROMO", "Account takeover")], "kind string, impact string")
    p = table(spark, sf_dir, "part")
    return p.join(F.broadcast(t), p["p_type"] == t["kind"], "left").select("p_partkey", F.coalesce("impact", F.concat(F.lit("Impact of "), "p_type", F.lit(" is unknown"))).alias("impact"))


@query("""
SELECT p_partkey, CASE WHEN contains(lower(p_name), 'steel') THEN '(exec|system)\\s*\\(' WHEN contains(lower(p_name), 'ring') THEN '(select|insert).*\\+' ELSE 'eval\\s*\\(' END AS pattern,
  'Detects ' || lower(p_name) || ' (' || p_type || ')' AS description FROM part
""")
def rules_from_threats(spark, sf_dir):
    """A pattern by the first keyword that fits, and a text from a template."""
    n = F.lower("p_name")
    pattern = F.when(n.contains("steel"), r"(exec|system)\s*\(").when(n.contains("ring"), r"(select|insert).*\+").otherwise(r"eval\s*\(")
    return table(spark, sf_dir, "part").select("p_partkey", pattern.alias("pattern"), F.concat(F.lit("Detects "), n, F.lit(" ("), "p_type", F.lit(")")).alias("description"))


@query("""
SELECT doc_id, requirement FROM documents, (VALUES ('license', 'Check licences'), ('rights', 'Review ownership'), ('@', 'Protect personal data')) t(trigger, requirement) WHERE contains(lower(text), trigger)
""")
def requirements_by_keyword(spark, sf_dir):
    """Templates whose trigger the text has; the triggers are literals of the projection."""
    rows = (("license", "Check licences"), ("rights", "Review ownership"), ("@", "Protect personal data"))
    hit = F.array_compact(F.array(*[F.when(F.lower("text").contains(k), F.lit(r)) for k, r in rows]))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(hit).alias("requirement"))


@query("""
SELECT technique, count(*) AS uses, CASE WHEN n_nationkey IS NULL THEN 'not_found' ELSE 'valid' END AS status FROM (SELECT unnest([CAST(user_id % 40 AS BIGINT), CAST(event_id % 30 AS BIGINT)]) AS technique FROM events) LEFT JOIN nation ON n_nationkey = technique GROUP BY technique, n_nationkey
""")
def technique_validation(spark, sf_dir):
    """Techniques named, counted first, then looked up: valid or not found."""
    e = table(spark, sf_dir, "events").select(F.explode(F.array((F.col("user_id") % 40).cast("long"), (F.col("event_id") % 30).cast("long"))).alias("technique")).groupBy("technique").agg(F.count("*").alias("uses"))
    j = e.join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")), F.col("technique") == F.col("k"), "left")
    return j.select("technique", "uses", F.when(F.col("k").isNull(), "not_found").otherwise("valid").alias("status"))


@query("""
SELECT doc_id, n_chars FROM documents WHERE lang IN ('en', 'de') AND (contains(lower(text), 'license') OR contains(lower(text), 'rights')) ORDER BY doc_id DESC LIMIT 20
""")
def sector_keyword_newest(spark, sf_dir):
    """The twenty newest entries that hold any keyword of a sector."""
    d = table(spark, sf_dir, "documents").where(F.col("lang").isin("en", "de")).where(F.exists(F.array(F.lit("license"), F.lit("rights")), lambda k: F.contains(F.lower("text"), k)))
    return d.orderBy(F.col("doc_id").desc()).limit(20).select("doc_id", "n_chars")
