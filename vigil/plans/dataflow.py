"""Taint within and between functions, calls and arguments. Twelve parts make a file of code, each of them one function:
its size and key choose what it assigns, calls, returns and gives to which sink."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import dataflow as D
from ..operators import programs as P
from ..operators import taint as T
from .registry import query, table

_PART = """p_partkey, p_partkey % 12 AS j, CONCAT('f', CAST((p_partkey - p_partkey % 12) AS {text}), '.js') AS path, (p_partkey % 12 * 5 + p_size) % 12 AS c,
 p_size % 6 AS v1, (p_partkey * 7 + p_size) % 4 AS v2, (p_partkey * 5 + p_size) % 3 AS v3, (p_partkey + p_size) % 5 AS s, (p_partkey * 3 + p_size) % 5 AS r"""
_LINES = [
    ["CONCAT('function f', j, '(a, b) {{')"],
    ["'  x = request.args.get(\"q\")'", "'  x = a'", "'  x = b + a'", "'  x = int(a)'", "'  x = 1'", "'  x = escape(b)'"],
    ["CONCAT('  y = f', c, '(\"(,\", x)')", "CONCAT('  y = f', c, '(g(b, 1), a)')", "'  y = x'", "'  y = y + 1'"],
    ["'  x = x'", "'  x = 2'", "'  x = y'"],
    ["'  db.execute(x)'", "'  os.system(y)'", "'  el.innerHTML = x'", "'  log(x)'", "'  os.system(shlex.quote(x))'"],
    ["'  return x'", "'  return y'", "'  return a'", "'  return 1'", "'  return b'"],
    ["'}}'"],
]
_BY = ["0", "v1", "v2", "v3", "s", "r", "0"]
_ARRAY = [[x.replace("{{", "{").replace("}}", "}") for x in xs] for xs in _LINES]


def code(spark, sf_dir):
    """(path, line_number, line): seven lines for each part."""
    p = table(spark, sf_dir, "part").selectExpr(*[x.strip() for x in _split(_PART.format(text="STRING"))])
    lines = F.array(*[F.expr(f"element_at(array({', '.join(xs)}), cast({by} + 1 as int))") for xs, by in zip(_ARRAY, _BY, strict=True)])
    return p.select("path", F.col("j").cast("long").alias("j"), F.posexplode(lines).alias("k", "line")).select("path", (F.col("j") * 7 + F.col("k") + 1).alias("line_number"), "line")


def _split(text: str) -> list[str]:
    """At commas outside of brackets."""
    return reduce(lambda out, c: [*out[:-1], out[-1] + c] if c != "," or out[-1].count("(") != out[-1].count(")") else [*out, ""], text, [""])


def _sql(between: bool) -> str:
    """The edges as they follow from the choices, without looking ta the code; then breadth first with DuckDB's recursion."""
    e = []  # (condition, from, from name, to, to name, passes)
    edge = lambda cond, a, an, b, bn, passes="'sql,command,html'": e.append(f"SELECT path, {a} AS fa, '{an}' AS fn, {b} AS ta, '{bn}' AS name, {passes} AS passes FROM p WHERE {cond}")
    a1, x2, y3, x4 = "st", "st + 1", "st + 2", "st + 3"
    edge("v1 IN (1, 2)", a1, "a", x2, "x")
    edge("v1 = 2", a1, "b", x2, "x")
    edge("v1 = 5", a1, "b", x2, "x", "'sql,command'")
    edge("v2 IN (0, 2)", x2, "x", y3, "y")
    edge("v2 = 1", a1, "a", y3, "y")
    edge("v2 = 1", a1, "b", y3, "y")
    edge("v3 = 0", x2, "x", x4, "x")
    edge("v3 = 2", y3, "y", x4, "x")
    edge("s = 0", x4, "x", "st + 4", "!sql", "'sql'")
    edge("s = 1", y3, "y", "st + 4", "!command", "'command'")
    edge("s = 2", x4, "x", "st + 4", "!html", "'html'")
    if between:
        for r, ta, name in ((0, x4, "x"), (1, y3, "y"), (2, a1, "a"), (4, a1, "b")):
            edge(f"r = {r}", ta, name, a1, "return")
        edge("known AND v2 = 0", x2, "x", "callee", "b")
        edge("known AND v2 = 1", a1, "b", "callee", "a")
        edge("known AND v2 = 1", a1, "a", "callee", "b")
        edge("known AND v2 < 2", "callee", "return", y3, "y")
    return rf"""
WITH RECURSIVE q AS (SELECT {_PART.format(text='VARCHAR')} FROM part), p AS (SELECT q.*, 7 * q.j + 1 AS st, 7 * q.c + 1 AS callee, o.j IS NOT NULL AS known FROM q LEFT JOIN (SELECT DISTINCT path, j FROM q) o ON o.path = q.path AND o.j = q.c
), e AS ({" UNION ".join(e)}
), k AS (SELECT DISTINCT path, fa, fn, ta, name, unnest(string_split(passes, ',')) AS kind FROM e
), r(path, ta, name, kind, hops) AS (SELECT path, st + 1, 'x', unnest(['sql', 'command', 'html']), 0 FROM p WHERE v1 = 0
  UNION SELECT k.path, k.ta, k.name, k.kind, r.hops + 1 FROM r JOIN k ON k.path = r.path AND k.fa = r.ta AND k.fn = r.name AND k.kind = r.kind WHERE r.hops < 75
), m AS (SELECT path, ta, name, kind, min(hops) AS hops FROM r GROUP BY ALL
), t(path, ta, name, kind, source) AS (SELECT path, ta, name, kind, ta FROM m WHERE hops = 0
  UNION SELECT k.path, k.ta, k.name, k.kind, t.source FROM t JOIN m a ON a.path = t.path AND a.ta = t.ta AND a.name = t.name AND a.kind = t.kind JOIN k ON k.path = t.path AND k.fa = t.ta AND k.fn = t.name AND k.kind = t.kind
    JOIN m b ON b.path = k.path AND b.ta = k.ta AND b.name = k.name AND b.kind = k.kind AND b.hops = a.hops + 1
), src AS (SELECT path, ta, name, kind, min(source) AS source FROM t GROUP BY ALL)
SELECT path, 'f' || CAST((ta - 5) // 7 AS VARCHAR) AS function, ta AS sink_line, kind, CASE kind WHEN 'sql' THEN 'CWE-89' WHEN 'command' THEN 'CWE-78' ELSE 'CWE-79' END AS cwe, CASE kind WHEN 'html' THEN 'high' ELSE 'critical' END AS severity,
  source AS source_line, CAST(hops AS INTEGER) AS hops, round(pow(0.95::DOUBLE, greatest(hops - 1, 0)), 6) AS confidence FROM m JOIN src USING (path, ta, name, kind) WHERE starts_with(name, '!')
"""


@query(_sql(True))
def interprocedural_flows(spark, sf_dir):
    """Sinks that tainted values reach, through arguments and returned values, with the nearest source."""
    return D.flows(code(spark, sf_dir))


@query(_sql(False))
def taint_flows(spark, sf_dir):
    """The same within functions: assigned again means clean, sanitizers stop their kind."""
    return D.flows(code(spark, sf_dir), between=False)


@query(f"""
WITH RECURSIVE q AS (SELECT {_PART.format(text='VARCHAR')} FROM part), c AS (SELECT path, 'f' || j AS caller, 'f' || c AS callee FROM q WHERE v2 < 2),
r(path, name) AS (SELECT path, 'f' || j FROM q WHERE s IN (0, 1, 4) UNION SELECT c.path, c.caller FROM r JOIN c ON c.path = r.path AND c.callee = r.name)
SELECT path, name FROM r
""")
def callgraph(spark, sf_dir):
    """Functions that reach a dangerous call."""
    calls = P.calls(code(spark, sf_dir))
    return T.spread(calls, calls.where("callee in ('os.system', 'db.execute')").select("path", F.col("caller").alias("name")))


@query(f"""
WITH q AS (SELECT {_PART.format(text='VARCHAR')} FROM part), a AS (
  SELECT path, 7 * j + 1 AS line_number, 'f' || j AS callee, 'a|b' AS args FROM q
  UNION ALL SELECT path, 7 * j + 2, CASE v1 WHEN 0 THEN 'request.args.get' WHEN 3 THEN 'int' ELSE 'escape' END, CASE v1 WHEN 0 THEN '"q"' WHEN 3 THEN 'a' ELSE 'b' END FROM q WHERE v1 IN (0, 3, 5)
  UNION ALL SELECT path, 7 * j + 3, 'f' || c, CASE v2 WHEN 0 THEN '"(,"|x' ELSE 'g(b, 1)|a' END FROM q WHERE v2 < 2
  UNION ALL SELECT path, 7 * j + 3, 'g', 'b|1' FROM q WHERE v2 = 1
  UNION ALL SELECT path, 7 * j + 5, CASE s WHEN 0 THEN 'db.execute' WHEN 1 THEN 'os.system' WHEN 3 THEN 'log' ELSE 'os.system' END, CASE s WHEN 1 THEN 'y' WHEN 4 THEN 'shlex.quote(x)' ELSE 'x' END FROM q WHERE s <> 2
  UNION ALL SELECT path, 7 * j + 5, 'shlex.quote', 'x' FROM q WHERE s = 4)
SELECT path, line_number, callee, args FROM a
""")
def call_arguments(spark, sf_dir):
    """Every call with its arguments, by brackets and strings."""
    return code(spark, sf_dir).select("path", "line_number", F.explode(D.call_arguments(F.col("line"))).alias("c")).select("path", "line_number", "c.callee", F.array_join("c.args", "|").alias("args"))
