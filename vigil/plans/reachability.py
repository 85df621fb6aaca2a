"""Reachability of advisories in code. Every part is a source file: its key chooses language and style of import, its size
package and call."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reachability as R
from .registry import query, table

PACKAGES = ["Lodash", "axios", "jwt", "qs", "left-pad", "unused"]
ECOSYSTEMS = ["npm", "pip", "go", "maven"]
#: ecosystem, (import, alias), per style; P is the package in lower case.
STYLES = {
    "npm": [("const _ = require('P');", "_"), ('import ax from "P"', "ax"), ("import * as ns from 'P';", "ns"), ("import { other, merge as m } from 'P'", ""), ("// import x from 'P'x", "x"), ("let { merge } = require('P')", "")],
    "pip": [("import P as r", "r"), ("import P", "P"), ("from P import other, merge as m", ""), ("from P import merge", ""), ("importP", "x"), ("    import P # here", "P")],
    "go": [('import j "github.com/x/P-go"', "j"), ('\t"example.org/P"', "P"), ("// P", "x"), ('import "example.org/P"', "P"), ('x := "P" + y', "x"), ('. "a/P/v2"', ".")],
    "maven": [("import org.P.Merge;", "Merge"), ("import static com.P.api.Tool;", "Tool"), ("package org.P;", "x"), ("import org.P.*;", "*"), ("import org.p.Q", "Q"), ("import a.P.Sub.Merge;", "Merge")],
}
#: (text with A for the alias, calls alias.merge, calls merge, calls m)
CALLS = [("  x = A.merge(a, b)", 1, 1, 0), ("  merge (a)", 0, 1, 0), ("  A.other(a); A.merged(a)", 0, 0, 0), ("  y = m(1)", 0, 0, 1), ("app.use(urlencoded)", 0, 0, 0)]
SIGNS = ["__PROTO__", "CERT_none"]


def _files(dialect: str) -> str:
    """SQL of (path, k, s, c, g, content) of parts."""
    q = lambda s: "'" + (s.replace("\\", "\\\\").replace("'", "\\'") if dialect == "spark" else s.replace("'", "''")) + "'"
    arr = lambda xs: f"array({', '.join(xs)})" if dialect == "spark" else f"[{', '.join(xs)}]"
    at = lambda a, i: f"element_at({a}, cast({i} + 1 as int))" if dialect == "spark" else f"({a})[{i} + 1]"
    eco = lambda f: at(arr([at(arr([q(f(x)) for x in STYLES[e]]), "s") for e in ECOSYSTEMS]), "k")
    ext = at(arr([q(x) for x in ("js", "py", "go", "java")]), "k")
    package = at(arr([q(p.lower()) for p in PACKAGES]), "g")
    line = f"replace({eco(lambda x: x[0])}, 'P', {package})"
    alias = f"replace({eco(lambda x: x[1])}, 'P', {package})"
    call = f"replace({at(arr([q(c[0]) for c in CALLS]), 'c')}, 'A', {alias})"
    sign = f"CASE WHEN p_partkey % 97 = 5 THEN {q(SIGNS[0].lower())} WHEN p_partkey % 89 = 7 THEN {q(SIGNS[1].upper())} ELSE '' END"
    nl = "'\\n'" if dialect == "spark" else "chr(10)"
    text = "STRING" if dialect == "spark" else "VARCHAR"
    return f"""SELECT CONCAT('src/m', CAST(p_partkey AS {text}), '.', {ext}) AS path, k, s, c, g, p_partkey, CONCAT('first', {nl}, {line}, {nl}, {call}, {nl}, {sign}) AS content
  FROM (SELECT p_partkey, p_partkey % 4 AS k, (p_partkey * 3 + p_size) % 6 AS s, (p_partkey * 7 + p_size) % 5 AS c, (p_partkey + p_size * 5) % 5 AS g FROM part)"""


def advisories(spark):
    """A catalog of one advisory per package and ecosystem."""
    rows = [(f"CVE-{e}-{p.lower()}", p, e, ["merge", "set"], [r"\bm\(1\)"] if p == "qs" else [], ["URLencoded"] if p == "axios" else [], SIGNS if p in ("Lodash", "jwt") else []) for e in ECOSYSTEMS for p in PACKAGES]
    return spark.createDataFrame(rows, "cve string, package string, ecosystem string, functions array<string>, call_patterns array<string>, middleware array<string>, indicators array<string>")


def _sql() -> str:
    # by ecosystem and style: is it an import, can merge be called by alias, by its own name, as m
    facts = {"npm": ["iA", "iA", "iA", "im", "iA", "iM"], "pip": ["iA", "iA", "im", "iM", "", "iA"], "go": ["iA", "iA", "", "iA", "", "i"], "maven": ["iA", "iA", "", "i", "", "iA"]}
    rows = ", ".join(f"({k}, {s}, {'i' in f}, {'A' in f}, {'M' in f}, {'m' in f})" for k, e in enumerate(ECOSYSTEMS) for s, f in enumerate(facts[e]))
    calls = ", ".join(f"({c}, {bool(a)}, {bool(m)}, {bool(x)})" for c, (_, a, m, x) in enumerate(CALLS))
    names = ", ".join(f"({k}, '{e}', {g}, '{p}')" for k, e in enumerate(ECOSYSTEMS) for g, p in enumerate(PACKAGES))
    return f"""
WITH f AS ({_files('duck')}), st(k, s, imported, by_alias, by_name, by_m) AS (VALUES {rows}), ca(c, alias_merge, merge, m) AS (VALUES {calls}), ad(k, e, g, p) AS (VALUES {names}
), j AS (SELECT f.*, st.imported AND NOT (st.k = 1 AND f.g = 4) AS imported, st.by_alias AND ca.alias_merge AND NOT (st.k = 2 AND f.s IN (1, 3) AND f.g = 4) OR st.by_name AND ca.merge OR st.by_m AND ca.m AS called, ca.m AS m FROM f JOIN st USING (k, s) JOIN ca USING (c)
), n AS (SELECT k, g, count(*) AS n_imports, count_if(called) + count_if(g = 3 AND m) + count_if(g = 1 AND c = 4) AS n_usages FROM j WHERE imported GROUP BY k, g
), x AS (SELECT k, bool_or(contains(lower(content), '__proto__') OR contains(lower(content), 'cert_none')) AS signs FROM f GROUP BY k
), r AS (SELECT ad.*, coalesce(n_imports, 0) AS n_imports, coalesce(n_usages, 0) AS n_usages, g IN (0, 2) AND coalesce(x.signs, false) AS indicated FROM ad LEFT JOIN n USING (k, g) LEFT JOIN x USING (k))
SELECT 'CVE-' || e || '-' || lower(p) AS cve, p AS package, CASE WHEN n_imports = 0 THEN 'not_reachable' WHEN n_usages = 0 THEN 'imported_only' WHEN indicated THEN 'exploitable' ELSE 'potentially_exploitable' END AS exploitability,
  CASE WHEN n_imports = 0 THEN 0.95 WHEN n_usages = 0 THEN 0.75 WHEN indicated THEN 0.95 ELSE 0.85 END::DOUBLE AS confidence, n_imports, CAST(n_usages AS BIGINT) AS n_usages, indicated FROM r
"""


@query(_sql())
def reachability_ladder(spark, sf_dir):
    """How far each advisory reaches: JavaScript, Python, Go and Java imports, calls by alias, by name and by pattern, signs of an exploit."""
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    return R.ladder(spark.sql(_files("spark")).select("path", "content"), advisories(spark))
