"""Versions, advisories and graphs. Versions and edges come from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import versions as V
from ..operators import advisories as A
from ..operators import graph as G
from ..operators import trees as Tr
from .registry import query, table

_VERSION = "CAST(p_size % 4 AS VARCHAR) || '.' || CAST(p_partkey % 12 AS VARCHAR) || '.' || CAST(p_partkey % 30 AS VARCHAR)"


@query(f"""
WITH d AS (SELECT p_partkey, p_brand, {_VERSION} AS version, p_size % 4 AS a, p_partkey % 12 AS b, p_partkey % 30 AS c FROM part),
x AS (SELECT *, CASE WHEN a = 1 AND b < 10 THEN 1 WHEN a = 2 AND b >= 3 AND (b < 11 OR (b = 11 AND c <= 4)) THEN 2 END AS ordinal FROM d WHERE p_brand IN ('Brand#11', 'Brand#23'))
SELECT p_partkey, version, CAST(ordinal AS INTEGER) AS ordinal FROM x WHERE ordinal IS NOT NULL
""")
def version_match(spark, sf_dir):
    """Advisory ranges: 1.0.0 <= v < 1.10.0, or 2.3.0 <= v <= 2.11.4 (numbers, not text, decide)."""
    d = table(spark, sf_dir, "part").select("p_partkey", F.lit("x").alias("ecosystem"), F.col("p_brand").alias("name"), F.expr(_VERSION.replace("VARCHAR", "STRING")).alias("version"))
    adv = spark.createDataFrame([(b, "x", o, v) for b in ("brand#11", "brand#23") for o, v in ((1, [">=1.0.0, <1.10.0"]), (2, [">= 2.3.0,<=2.11.4"]))], "package string, ecosystem string, ordinal int, versions array<string>")
    # the part is the dependency: one first match each
    return A.matches(d.withColumn("name", F.col("name")), adv, first_only=False).groupBy("p_partkey", "version").agg(F.min("ordinal").alias("ordinal"))


@query(f"""
SELECT {_VERSION} AS version, count(*) AS n, row_number() OVER (ORDER BY p_size % 4, p_partkey % 12, p_partkey % 30)::INTEGER AS place FROM part GROUP BY p_size % 4, p_partkey % 12, p_partkey % 30, 1
""")
def version_order(spark, sf_dir):
    """Distinct versions in version order; the key is a text, so ranges and sorts stay in the JVM. Bounded by the version grid."""
    from pyspark.sql import Window

    v = table(spark, sf_dir, "part").groupBy(F.expr(_VERSION.replace("VARCHAR", "STRING")).alias("version")).agg(F.count("*").alias("n"))
    return v.withColumn("place", F.row_number().over(Window.orderBy(V.sort_key(F.col("version")))))


@query("""
SELECT s_suppkey, CASE WHEN s_nationkey < 8 THEN 'risk' WHEN s_nationkey > 18 THEN 'unknown' END AS finding, CASE WHEN s_nationkey < 4 THEN 'high' ELSE 'medium' END AS severity FROM supplier WHERE s_nationkey < 8 OR s_nationkey > 18
""")
def license_lookup(spark, sf_dir):
    """Left join to licences: risky ones and unknown ones are findings."""
    d = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("name"), F.col("s_nationkey").alias("license"))
    lic = spark.range(19).select(F.col("id").cast("int").alias("license"), F.expr("CASE WHEN id < 4 THEN 'high' WHEN id < 8 THEN 'medium' ELSE 'low' END").alias("risk"))
    return A.license_risk(d, lic).select(F.col("name").alias("s_suppkey"), "finding", "severity")


_EDGES = "SELECT DISTINCT n_nationkey AS src, (n_nationkey * 3 + 1) % 25 AS dst FROM nation UNION SELECT n_nationkey, (n_nationkey + n_regionkey + 1) % 25 FROM nation"


def _edges(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    e = n.selectExpr("n_nationkey AS src", "(n_nationkey * 3 + 1) % 25 AS dst").union(n.selectExpr("n_nationkey", "(n_nationkey + n_regionkey + 1) % 25")).distinct()
    return e.where("src <> dst")


@query(f"""
WITH RECURSIVE e AS (SELECT * FROM ({_EDGES}) WHERE src <> dst), p(start, node, depth, path) AS (SELECT n_nationkey, n_nationkey, 0, [n_nationkey] FROM nation WHERE n_nationkey < 5
  UNION ALL SELECT p.start, e.dst, p.depth + 1, list_append(p.path, e.dst) FROM p JOIN e ON e.src = p.node WHERE NOT list_contains(p.path, e.dst) AND p.depth < 5)
SELECT start, node, CAST(depth AS INTEGER) AS depth, array_to_string(path, '>') AS path FROM p WHERE depth > 0
""")
def simple_paths(spark, sf_dir):
    starts = table(spark, sf_dir, "nation").where("n_nationkey < 5").select(F.col("n_nationkey").alias("start"))
    return G.simple_paths(_edges(spark, sf_dir), starts, 5).select("start", "node", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query(f"""
WITH RECURSIVE e AS (SELECT * FROM ({_EDGES}) WHERE src <> dst), p(start, node, depth, path) AS (SELECT n_nationkey, n_nationkey, 0, [n_nationkey] FROM nation WHERE n_nationkey < 5
  UNION ALL SELECT p.start, e.dst, p.depth + 1, list_append(p.path, e.dst) FROM p JOIN e ON e.src = p.node WHERE NOT list_contains(p.path, e.dst) AND p.depth < 5),
r AS (SELECT *, row_number() OVER (PARTITION BY start, node ORDER BY depth, path) AS rn FROM p WHERE depth > 0 AND node >= 20)
SELECT start, node, CAST(depth AS INTEGER) AS depth, array_to_string(path, '>') AS path FROM r WHERE rn = 1
""")
def shortest_chain(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    c = G.shortest_chains(_edges(spark, sf_dir), n.where("n_nationkey < 5").select(F.col("n_nationkey").alias("start")), n.where("n_nationkey >= 20").select(F.col("n_nationkey").alias("end")), 5)
    return c.select("start", "node", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query(f"""
WITH RECURSIVE e AS (SELECT * FROM ({_EDGES}) WHERE src <> dst), c(src, dst) AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON e.src = c.dst)
SELECT src, count(*) AS reach, bool_or(src = dst) AS recursive FROM c GROUP BY src
""")
def closure(spark, sf_dir):
    """What each node reaches, and whether it reaches itself; each round doubles the reach."""
    c = G.closure(_edges(spark, sf_dir))
    return c.groupBy("src").agg(F.count("*").alias("reach"), F.bool_or(F.col("src") == F.col("dst")).alias("recursive"))


_PARENT = "CASE WHEN p_partkey > 1 THEN p_partkey - 1 - p_size % 2 WHEN p_partkey = 1 THEN 0 END"
_SEVERITY = "CASE p_size % 7 WHEN 0 THEN 'critical' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'medium' WHEN 3 THEN 'other' END"


@query(f"""
WITH RECURSIVE t AS (SELECT p_partkey AS k, {_PARENT} AS up, {_SEVERITY} AS severity FROM part),
a(k, anc, n) AS (SELECT k, k, 0 FROM t UNION ALL SELECT a.k, t.up, a.n + 1 FROM a JOIN t ON t.k = a.anc WHERE t.up IS NOT NULL),
w AS (SELECT k, max(n) AS depth, md5(string_agg('p' || anc, '>' ORDER BY n DESC)) AS way_md5, 'p' || arg_max(anc, n) AS root FROM a GROUP BY k),
b AS (SELECT a.anc AS k, count(severity) AS below, count(*) FILTER (severity = 'critical') AS below_critical, count(*) FILTER (severity = 'HIGH') AS below_high, count(*) FILTER (severity = 'medium') AS below_medium FROM a JOIN t ON t.k = a.k GROUP BY a.anc)
SELECT 'p' || w.k AS name, CAST(depth AS INTEGER) AS depth, root, way_md5, CAST((t.severity IS NOT NULL)::INT AS BIGINT) AS own, below, CAST(below_critical AS BIGINT) AS below_critical, CAST(below_high AS BIGINT) AS below_high, CAST(below_medium AS BIGINT) AS below_medium
FROM w JOIN b USING (k) JOIN t USING (k)
""")
def dependency_rollup(spark, sf_dir):
    """A tree as deep as half of all parts or more: depth, root and way of each package, and the findings in its subtree."""
    p = table(spark, sf_dir, "part").selectExpr("'x' AS path", "concat('p', p_partkey) AS name", f"concat('p', {_PARENT}) AS parent", f"{_SEVERITY} AS severity")
    r = Tr.rollup(p, p.where("severity is not null"), digest=True)
    return r.select("name", "depth", "root", "way_md5", "own", "below", "below_critical", "below_high", "below_medium")


@query("""
WITH RECURSIVE p AS (SELECT p_partkey AS k, p_partkey % 5 AS f, (p_partkey * 7 + 15) AS d1, p_partkey - 5 * (p_size % 9) - 5 AS d2 FROM part),
e AS (SELECT p.f, p.k, q.k AS d FROM p JOIN p q ON q.f = p.f AND q.k IN (p.d1 - (p.d1 - p.f) % 5, p.d2) AND q.k <> p.k),
r(f, k, depth) AS (SELECT f, k, 0 FROM p WHERE k % 50 < 5 UNION SELECT e.f, e.d, r.depth + 1 FROM r JOIN e ON e.f = r.f AND e.k = r.k WHERE r.depth < 40),
m AS (SELECT f, k, min(depth) AS depth FROM r GROUP BY ALL),
u AS (SELECT e.f, e.d AS k, min('p' || e.k) AS parent FROM e JOIN m a ON a.f = e.f AND a.k = e.k JOIN m b ON b.f = e.f AND b.k = e.d AND b.depth = a.depth + 1 GROUP BY ALL)
SELECT 'f' || p.f AS path, 'p' || p.k AS name, CAST(m.depth AS INTEGER) AS depth, u.parent, coalesce(m.depth = 0, false) AS is_direct FROM p LEFT JOIN m USING (f, k) LEFT JOIN u USING (f, k)
""")
def lockfile_depths(spark, sf_dir):
    """Graphs with cycles, one per file: fewest edges from a direct dependency, and the package that leads there."""
    p = table(spark, sf_dir, "part").selectExpr("p_partkey k", "p_partkey % 5 f", "p_partkey * 7 + 15 d1", "p_partkey - 5 * (p_size % 9) - 5 d2").selectExpr("concat('f', f) path", "concat('p', k) name", "k", "explode(array(d1 - (d1 - f) % 5, d2)) d")
    return Tr.depths(p, p.selectExpr("path", "name", "concat('p', d) dependency"), p.where("k % 50 < 5").select("path", "name"))
