"""Scopes of functions against a stack worked through line by line."""

import random
import re

from vigil.operators import programs as P


def by_stack(lines):
    stack, braces, found, calls = [], 0, [], []
    for n, line in enumerate(lines, 1):
        if m := re.search(P.DEFINITION, line):
            found.append([m[1], n, n])
            stack.append(found[-1])
        braces += line.count("{") - line.count("}")
        if braces <= 0 and stack:
            stack.pop()[2] = n
        for c in re.findall(P.CALL, line):
            if c.split(".")[-1] not in P.NOT_CALLED:
                calls.append((stack[-1][0] if stack else P.MODULE, c, n))
    return sorted(map(tuple, found)), sorted(calls)


def test_scopes_and_calls(spark):
    rng = random.Random(3)
    some = ["function f1(a) {", "function f2(a) { g(a) }", "def f3(a):", "if (x) {", "}", "} }", "{ {", "h.k(x) + m()", "", "return f1 (x)"]
    files = {p: [rng.choice(some) for _ in range(rng.randint(1, 40))] for p in range(60)} | {99: [""]}
    lined = spark.createDataFrame([(p, n, t or None) for p, f in files.items() for n, t in enumerate(f, 1)], "path long, line_number long, line string")
    found, calls = {}, {}
    for r in P.functions(lined).collect():
        found.setdefault(r.path, []).append((r["name"], r.start_line, r.end_line))
    for r in P.calls(lined).collect():
        calls.setdefault(r.path, []).append((r.caller, r.callee, r.line_number))
    for p, f in files.items():
        assert (sorted(found.get(p, [])), sorted(calls.get(p, []))) == by_stack(f)


def test_control_flow(spark):
    lined = spark.createDataFrame([("a", 1, "if (x)"), ("a", 2, " "), ("a", 3, "  return y"), ("a", 4, "z()"), ("b", 1, None)], "path string, line_number int, line string")
    got = sorted(tuple(r) for r in P.control_flow(lined).collect())
    assert got == [("a", 0, 1, "entry"), ("a", 1, 3, "condition"), ("a", 3, -1, "return"), ("a", 3, 4, "return"), ("a", 4, -1, "statement"), ("b", 0, -1, "entry")]


def test_empty(spark):
    none = spark.createDataFrame([], "path string, line_number long, line string")
    assert all(f(none).isEmpty() for f in (P.functions, P.calls, P.control_flow, P.data_flow, P.summaries))


def test_odd_parameters(spark):
    lined = spark.createDataFrame([(1, 1, "function f(x: str, **kw, $y = 2) {"), (1, 2, "os.system($y)"), (1, 3, "}")], "path int, line_number int, line string")
    r = P.summaries(lined).first()
    assert (r.params, r.end_line, r.returns_tainted) == ("x,$y", 3, False)


def test_lines_are_dealt_by_number(spark):
    lined = spark.range(1000).selectExpr("id % 50 AS path", "id AS line_number", "'function f(a) {' AS line")
    dealt = P.deal(lined, rows=100)
    assert dealt.rdd.getNumPartitions() == 10 and P.functions(dealt).rdd.getNumPartitions() == 10 and P.functions(dealt).count() == 1000
