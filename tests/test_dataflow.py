"""Arguments of calls, reaching definitions, and taint between functions."""

import random

from pyspark.sql import functions as F

from vigil.operators import dataflow as D


def by_hand(line):
    """(callee, args) of one line, character by character."""
    import re

    from vigil.operators.programs import NOT_CALLED

    out, stack, quote, i = [], [], None, 0
    heads = {m.end(): m[1] for m in re.finditer(r"([\w.]+)\s*\(", line)}
    while i < len(line):
        c = line[i]
        if quote:
            for f in stack:
                f[1] += c
            if c == "\\" and i + 1 < len(line):
                i += 1
                for f in stack:
                    f[1] += line[i]
            elif c == quote:
                quote = None
        elif c in "\"'`":
            quote = c
            for f in stack:
                f[1] += c
        elif c == "(":
            for f in stack:
                f[1] += c
            stack.append([heads.get(i + 1), "", []])
        elif c == ")" and stack:
            name, arg, args = stack.pop()
            out.append((name, [*args, arg.strip()]))
            for f in stack:
                f[1] += c
        elif c == "," and stack:
            stack[-1][2].append(stack[-1][1].strip())
            stack[-1][1] = ""
            for f in stack[:-1]:
                f[1] += c
        else:
            for f in stack:
                f[1] += c
        i += 1
    out += [(n, a) for n, _, a in stack]
    return sorted((n, [x for x in a if x][:10]) for n, a in out if n and n.split(".")[-1] not in NOT_CALLED)


def test_call_arguments(spark):
    rng = random.Random(5)
    lines = ["f(a, g(b, 1), 'x,(y')", 'a.b.run("q\\"(,", `t(,`)', "if (x) { go(y) }", "f(,a,,b)", "open(a, 'b", "x = h ( 1 , (2, 3) )", "no call", "", ")f(a)(b)", "f(" + ", ".join(map(str, range(14))) + ")", "é(ü, f(ß))"]
    lines += ["".join(rng.choice(["f(", "g.h (", "(", ")", ",", "a", "b ", '"', "'", "\\", "if(", "1"]) for _ in range(rng.randrange(30))) for _ in range(400)]
    lines = [x for x in lines if "\\" not in x or "\\\"" in x]  # what follows a backslash outside of strings differs by taste
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string").select("i", D.call_arguments(F.col("line")).alias("c")).collect()
    for r in got:
        assert sorted((c.callee, list(c.args)) for c in r.c) == by_hand(lines[r.i]), lines[r.i]


def test_assignments(spark):
    lines = {"x = f(y)": "x", "const q = req.query.a;": "q", "rows, err := db.Get(id)": "rows", "$name = $_GET['n'];": "name", "String s = r.get(1);": "s", "let n: number = 1": "n", "x == 1": "", "a != b": "", "x += 1": "", "el.innerHTML = x": "", "if x == 1:": "", "(a) => b": ""}
    got = spark.createDataFrame([(k,) for k in lines], "line string").select("line", F.regexp_extract("line", D.ASSIGNMENT, 1).alias("v")).collect()
    assert {r.line: r.v for r in got} == lines


CODE = """function handler(req) {
  q = req.query.id
  s = 'SELECT ' + q
  db.query(s)
  run("ls, (x", s)
  q = 1
  db.query(q)
  clean = parseInt(s)
  n = int(s)
  db.query(n)
  h = escape(s)
  el.innerHTML = h
  db.query(h)
  r = twice(s)
  os.system(r)
}
function run(label, cmd) {
  os.system(cmd)
  os.system(label)
  os.system(shlex.quote(cmd))
}
function twice(v) {
  w = once(v)
  return w
}
function once(u) {
  return u + u
}
function loop(a, b) {
  os.system(b)
  loop(b, a)
}
function start(req) {
  loop(req.query.x, 1)
  db.query("SELECT ?", req.query.y)
  eval(req.body)
}
// eval(req.body)
""".split("\n")


def test_flows(spark):
    lined = spark.createDataFrame([("a.js", i + 1, x) for i, x in enumerate(CODE)] + [("b.js", 1, "function run(label, cmd) {"), ("b.js", 2, "os.system(cmd)"), ("b.js", 3, "}"), ("c.js", 1, None)], "path string, line_number int, line string").repartition(3)
    line = lambda text, nth=0: [i + 1 for i, x in enumerate(CODE) if x.strip() == text][nth]
    got = {(r.sink_line, r.kind): (r.source_line, r.hops, r.function) for r in D.flows(lined).collect()}
    assert got == {
        (line("db.query(s)"), "sql"): (2, 2, "handler"), (line("db.query(h)"), "sql"): (2, 3, "handler"), (line("os.system(cmd)"), "command"): (2, 3, "run"), (line("os.system(r)"), "command"): (2, 3, "handler"),
        (line("os.system(b)"), "command"): (line("loop(req.query.x, 1)"), 2, "loop"), (line("eval(req.body)"), "code"): (line("eval(req.body)"), 0, "start"),
    }
    inside = {(r.sink_line, r.kind) for r in D.flows(lined, between=False).collect()}
    assert inside == {(4, "sql"), (line("db.query(h)"), "sql"), (line("os.system(r)"), "command"), (line("eval(req.body)"), "code")}
    r = {(x.sink_line, x.kind): x for x in D.flows(lined).collect()}[4, "sql"]
    assert (r.cwe, r.severity, r.confidence) == ("CWE-89", "critical", 0.95)


def test_function_on_one_line(spark):
    code = ["function f(a) { eval(a) }", "function g(req) {", "  f(req.body)", "}"]
    got = D.flows(spark.createDataFrame([("x", i + 1, t) for i, t in enumerate(code)], "path string, line_number int, line string")).collect()
    assert [(r.function, r.sink_line, r.hops, r.source_line) for r in got] == [("f", 1, 1, 3)]


def test_no_lines(spark):
    assert D.flows(spark.createDataFrame([], "path string, line_number int, line string")).collect() == []


def test_long_chain_and_cycle(spark):
    n = 12
    code = []
    for i in range(n):
        code += [f"function f{i}(p) {{", f"  f{(i + 1) % n}(p)", "  eval(p)", "}"]
    code += ["function go(req) {", "  f0(req.query.a)", "}"]
    got = D.flows(spark.createDataFrame([("x", i + 1, t) for i, t in enumerate(code)], "path string, line_number int, line string")).collect()
    assert {(r.function, r.hops) for r in got} == {(f"f{i}", i + 1) for i in range(n)}


def test_long_chains_keep_few_tables_and_no_broadcast(spark):
    """Facts of many rounds are merged, and what grows with the code is not sent through the driver."""
    lines = ["function f(a) {", "  x0 = request.args.q", *[f"  x{i + 1} = x{i}" for i in range(20)], "  db.execute(x20)", "}"]
    out = D.flows(spark.createDataFrame([("p", i + 1, x) for i, x in enumerate(lines)], "path string, line_number long, line string"), between=False)
    assert [(r.hops, r.source_line, r.sink_line) for r in out.collect()] == [(21, 2, 23)]
    plan = out._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" not in plan and out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= D.TABLES + 2
