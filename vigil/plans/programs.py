"""Structure of programs; each order stands for a file, its items for lines of code."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import canonical as C
from ..operators import programs as P
from ..operators.taint import SANITIZERS, SINKS, SOURCES
from .registry import query, table

_ROW = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)"
_LINE = """
CASE l_partkey % 8 WHEN 0 THEN 'function f' || (l_suppkey % 7) || '(a, b = 1, *c) {' WHEN 1 THEN '}' WHEN 2 THEN 'x' || (l_suppkey % 3) || ' = x' || (l_linenumber % 3) || ' + b'
  WHEN 3 THEN 'if (x1 > g.h(a)) {' WHEN 4 THEN 'return db.query(a)' WHEN 5 THEN '' WHEN 6 THEN 'y = int(request.args) + a; f1(y) }' ELSE 'function f' || (l_suppkey % 5) || '(b) { os.system(b) }' END
"""
_CODE = f"SELECT l_orderkey AS path, {_ROW} AS line_number, {_LINE} AS line FROM lineitem"
_EVENTS = rf"""
c AS ({_CODE}),
n AS (SELECT *, nullif(regexp_extract(line, '{P.DEFINITION}', 1), '') AS name, sum(length(replace(line, '}}', '')) - length(replace(line, '{{', ''))) OVER (PARTITION BY path ORDER BY line_number) AS b FROM c),
s AS (SELECT *, sum((name IS NOT NULL)::INT - (b <= 0)::INT) OVER (PARTITION BY path ORDER BY line_number) AS s FROM n),
d AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY path ORDER BY line_number)) AS depth FROM s),
l AS (SELECT *, coalesce(lag(depth) OVER (PARTITION BY path ORDER BY line_number), 0) + (name IS NOT NULL)::INT AS high FROM d),
e AS (SELECT path, line_number, line, name, high AS level, 0 AS kind FROM l WHERE name IS NOT NULL UNION ALL SELECT path, line_number, line, name, high, 1 FROM l WHERE b <= 0 AND high > 0
  UNION ALL SELECT path, line_number, line, name, depth, 2 FROM l),
r AS (SELECT *, last_value(CASE WHEN kind = 0 THEN name END IGNORE NULLS) OVER (PARTITION BY path, level ORDER BY line_number, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top,
  first_value(CASE WHEN kind = 1 THEN line_number END IGNORE NULLS) OVER (PARTITION BY path, level ORDER BY line_number, kind ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS closed FROM e),
f AS (SELECT path, name, line_number AS start_line, coalesce(closed, line_number) AS end_line, line FROM r WHERE kind = 0)
"""


def _code(spark, sf_dir):
    lines = P.deal(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"), "l_orderkey")
    return lines.selectExpr("l_orderkey AS path", f"{_ROW} AS line_number", f"{_LINE} AS line")


@query(f"WITH {_EVENTS} SELECT path, name, start_line, end_line FROM f")
def function_scopes(spark, sf_dir):
    """Functions with their first and last line, by braces."""
    return P.functions(_code(spark, sf_dir)).drop("line")


@query(rf"""
WITH {_EVENTS}, k AS (SELECT path, line_number, coalesce(top, '<module>') AS caller, unnest(regexp_extract_all(line, '{P.CALL}', 1)) AS callee FROM r WHERE kind = 2)
SELECT path, caller, callee, line_number FROM k WHERE string_split(callee, '.')[-1] NOT IN {P.NOT_CALLED}
""")
def generic_calls(spark, sf_dir):
    """Call sites of any language with the function they stand in."""
    return P.calls(_code(spark, sf_dir))


@query(rf"""
WITH c AS ({_CODE}), b AS (SELECT path, line_number, CASE {" ".join(f"WHEN regexp_matches(line, '{p}') THEN '{k}'" for k, p in P.LINE_CLASSES)} ELSE 'statement' END AS kind FROM c WHERE line <> ''),
w AS (SELECT *, lag(line_number) OVER (PARTITION BY path ORDER BY line_number) AS before, lead(line_number) OVER (PARTITION BY path ORDER BY line_number) AS after FROM b)
SELECT path, 0 AS src, line_number AS dst, 'entry' AS kind FROM w WHERE before IS NULL UNION ALL SELECT path, line_number, after, kind FROM w WHERE after IS NOT NULL
UNION ALL SELECT path, line_number, -1, kind FROM w WHERE after IS NULL OR kind = 'return' UNION ALL SELECT path, 0, -1, 'entry' FROM c GROUP BY path HAVING max(line) = ''
""")
def control_flow(spark, sf_dir):
    """Successors of each line, with entry and exit."""
    return P.control_flow(_code(spark, sf_dir))


@query(rf"""
WITH c AS ({_CODE}), n AS (SELECT *, nullif(regexp_extract(line, '{P.ASSIGNMENT}', 1), '') AS target, regexp_extract(line, '{P.ASSIGNMENT}', 2) AS value FROM c),
p AS (SELECT path, line_number, unnest(CASE WHEN contains(line, '(a, b') THEN ['a', 'b'] ELSE ['b'] END) AS variable FROM c WHERE starts_with(line, 'function')),
v AS (SELECT path, target AS variable FROM n WHERE target IS NOT NULL UNION SELECT path, variable FROM p),
u AS (SELECT path, line_number, target, unnest(list_distinct(regexp_extract_all(line, '\w+'))) AS variable FROM n),
q AS (SELECT DISTINCT path, target, unnest(regexp_extract_all(value, '\w+')) AS variable FROM n WHERE target IS NOT NULL)
SELECT path, 'assignment' AS kind, target AS variable, line_number, NULL AS target FROM n WHERE target IS NOT NULL UNION ALL SELECT path, 'parameter', variable, line_number, NULL FROM p
UNION ALL SELECT path, 'use', variable, line_number, NULL FROM u JOIN v USING (path, variable) WHERE target IS NULL OR target <> variable
UNION ALL SELECT path, 'dependency', variable, NULL, target FROM q JOIN v USING (path, variable) WHERE target <> variable
""")
def data_flow(spark, sf_dir):
    """Definitions, uses and dependencies of variables."""
    return P.data_flow(_code(spark, sf_dir))


def _near(kind: str, sink: str) -> str:
    both = rf"'(?i)\b' || p || '\b[^;{{}}]*(?:{sink})|(?:{sink})[^;{{}}]*\b' || p || '\b'"
    return f"list_transform(list_filter(params, lambda p: regexp_matches(body, {both})), lambda p: p || ':{kind}')"


_SOURCE = "|".join(SOURCES.values())


@query(rf"""
WITH {_EVENTS}, t AS (SELECT f.path, name, start_line, end_line, any_value(CASE WHEN contains(f.line, '(a, b') THEN ['a', 'b'] ELSE ['b'] END) AS params, string_agg(c.line, chr(10) ORDER BY line_number) AS body
  FROM f JOIN c ON f.path = c.path AND line_number BETWEEN start_line AND end_line GROUP BY 1, 2, 3, 4)
SELECT path, name, start_line, end_line, array_to_string(params, ',') AS params, array_to_string(list_sort(flatten([{", ".join(_near(k, v[0]) for k, v in SINKS.items())}])), ',') AS sinks,
  array_to_string(list_sort(list_filter([{", ".join(f"CASE WHEN regexp_matches(body, '{p}') THEN '{k}' END" for k, p in SANITIZERS.items())}], lambda x: x IS NOT NULL)), ',') AS sanitizes,
  len(list_filter(params, lambda p: regexp_matches(body, 'return\s+.*\b' || p || '\b'))) > 0 OR regexp_matches(body, '{_SOURCE}') AS returns_tainted, regexp_matches(body, '{_SOURCE}') AS calls_source FROM t
""")
def function_summaries(spark, sf_dir):
    """What each function does with its parameters."""
    return P.summaries(_code(spark, sf_dir))


@query("""
SELECT r_regionkey, sha256('{"components": [' || string_agg('{"id": ' || n_nationkey || ', "name": "' || n_name || '"}', ', ' ORDER BY n_nationkey) || '], "name": "' || any_value(r_name) || '"}') AS hash
FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey
""")
def architecture_hash(spark, sf_dir):
    """A hash of each snapshot that does not depend on the order of keys."""
    n = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", C.fields(name=C.text(F.col("n_name")), id=C.number(F.col("n_nationkey"))).alias("json"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "json"))), lambda x: x["json"])
    n = n.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(C.items(parts).alias("components"))
    r = table(spark, sf_dir, "region").join(n, "r_regionkey")
    return r.select("r_regionkey", C.digest(C.fields(name=C.text(F.col("r_name")), components=F.col("components"))).alias("hash"))
