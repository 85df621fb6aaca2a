"""Dataflow per file: taint from sources to sinks, call graphs, and facts that spread along calls.

A file is the unit: its lines are worked through in order by a grouped-map function over (path, content) rows, one row
per file, so nothing is collected across files. Facts between functions are joins on edges.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.secrets import flow_id
from .iterate import cut

# A small default catalog of definitions; larger ones are passed in with the same shape.
SOURCES = {"user_input": r"request\.(?:args|form|json|data|params|query|body|GET|POST)|input\(|sys\.argv|req\.(?:query|body|params)"}
SINKS = {
    "sql": (r"\.(?:execute|executemany|raw|query)\s*\(", "CWE-89", "critical"), "command": (r"os\.system\s*\(|subprocess\.\w+\s*\(|\bexec(?:Sync)?\s*\(", "CWE-78", "critical"),
    "code": (r"\beval\s*\(", "CWE-95", "critical"), "html": (r"\.innerHTML\s*=|render_template_string\s*\(", "CWE-79", "high"), "path": (r"\bopen\s*\(|readFile(?:Sync)?\s*\(", "CWE-22", "high"), "url": (r"requests\.\w+\s*\(|urlopen\s*\(|\bfetch\s*\(", "CWE-918", "high"),
}
SANITIZERS = {"sql": r"\bint\(|\bescape_string\(|parameterize", "command": r"shlex\.quote\(", "html": r"\bescape\(|sanitize|textContent", "path": r"basename\(|secure_filename\(", "any": r"\bint\(|\bfloat\("}

_ASSIGN = re.compile(r"^\s*(?:const |let |var )?([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=(?!=)\s*(.+)$")
DECAY = 0.95


def _uses(text: str, name: str) -> bool:
    return re.search(rf"(?<![\w$]){re.escape(name)}(?![\w$])", text) is not None


def flows_of(content: str) -> Iterator[dict]:
    """Flows of one file. All assignments are seen before the sinks, as the analysis does not follow the order of statements."""
    lines = content.split("\n")
    tainted: dict[str, dict] = {}
    seen: set = set()
    while True:  # until nothing changes, or a state comes back (assignments that overwrite each other)
        before = {k: (v["line"], v["hops"], tuple(sorted(v["clean"]))) for k, v in tainted.items()}
        for n, line in enumerate(lines, 1):
            if line.lstrip().startswith(("#", "//")) or not (m := _ASSIGN.match(line)):
                continue
            name, value = m.groups()
            clean = {k for k, p in SANITIZERS.items() if re.search(p, value)}
            if any(re.search(p, value) for p in SOURCES.values()):
                tainted[name] = {"line": n, "hops": 0, "clean": clean}
            else:
                used = [v for k, v in tainted.items() if k != name and _uses(value, k)]
                if used:
                    v = min(used, key=lambda v: (v["hops"], v["line"]))
                    tainted[name] = {"line": v["line"], "hops": min(v["hops"] + 1, 50), "clean": v["clean"] | clean}
        after = {k: (v["line"], v["hops"], tuple(sorted(v["clean"]))) for k, v in tainted.items()}
        state = tuple(sorted(after.items()))
        if before == after or state in seen:
            break
        seen.add(state)
    for n, line in enumerate(lines, 1):
        if line.lstrip().startswith(("#", "//")):
            continue
        for kind, (pattern, cwe, severity) in SINKS.items():
            m = re.search(pattern, line)
            if not m:
                continue
            args = line[m.end() :]
            if kind == "sql" and re.search(r"[?%]s?['\"]\s*,", args):
                continue  # bound parameters
            direct = any(re.search(p, args) for p in SOURCES.values()) and not re.search(SANITIZERS.get(kind, "(?!)"), args)
            hit = [(v, k) for k, v in tainted.items() if _uses(args, k) and not v["clean"] & {kind, "any"} and not re.search(SANITIZERS.get(kind, "(?!)"), args)]
            if direct:
                yield {"source_line": n, "sink_line": n, "sink": kind, "variable": "", "cwe": cwe, "severity": severity, "confidence": 1.0}
            elif hit:
                v, k = min(hit, key=lambda x: (x[0]["hops"], x[0]["line"], x[1]))
                yield {"source_line": v["line"], "sink_line": n, "sink": kind, "variable": k, "cwe": cwe, "severity": severity, "confidence": DECAY ** v["hops"]}


def flows(files: DataFrame) -> DataFrame:
    """(path, source_line, sink_line, sink, variable, cwe, severity, confidence, flow_id) of files (path, content)."""
    schema = "path string, source_line long, sink_line long, sink string, variable string, cwe string, severity string, confidence double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"path": p, **f} for p, c in zip(b["path"], b["content"], strict=True) if c for f in flows_of(c)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    return files.select("path", "content").mapInPandas(run, schema).withColumn("flow_id", flow_id(F.col("path"), F.col("sink_line"), F.col("sink")))


def calls_of(content: str) -> Iterator[tuple[str, str, int]]:
    """(caller, callee, line) of one Python file; what does not parse gives nothing."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError):
        return
    for f in ast.walk(tree):
        if isinstance(f, ast.FunctionDef | ast.AsyncFunctionDef):
            for c in ast.walk(f):
                if isinstance(c, ast.Call):
                    name = c.func.id if isinstance(c.func, ast.Name) else c.func.attr if isinstance(c.func, ast.Attribute) else None
                    if name:
                        yield f.name, name, c.lineno


def call_graph(files: DataFrame) -> DataFrame:
    """(path, caller, callee, line) of Python files (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, *c) for p, t in zip(b["path"], b["content"], strict=True) if t for c in calls_of(t)], columns=["path", "caller", "callee", "line"])

    return files.select("path", "content").mapInPandas(run, "path string, caller string, callee string, line long")


def spread(calls: DataFrame, facts: DataFrame) -> DataFrame:
    """Functions that reach one with a fact through calls: (path, name). Each round is an anti-joined step outward, until none is new."""
    calls = cut(calls.select("path", "caller", "callee").distinct())
    known = front = cut(facts.select("path", "name").distinct())
    while True:
        up = calls.join(front.withColumnRenamed("name", "callee"), ["path", "callee"]).select("path", F.col("caller").alias("name")).distinct()
        front = cut(up.join(known, ["path", "name"], "left_anti"))
        if front.isEmpty():
            return known
        known = known.union(front)


# Rungs of the ladder, from what least to what most speaks for exploitability.
LADDER = ("not_reachable", "imported_only", "potentially_exploitable", "exploitable")


def reachability(dependencies: DataFrame, files: DataFrame, functions: DataFrame) -> DataFrame:
    """(package, version, exploitability): is a vulnerable package imported, is one of its functions called, by an exposed file?

    dependencies (package, version), files (path, content), functions (package, function). Imports and calls meet in
    equi-joins on file and alias; no package is compared with every line.
    """
    from .textscan import lines

    l = lines(files, "path", "content")
    imp = l.select(
        "path",
        F.coalesce(*[F.nullif(F.regexp_extract("line", p, 2), F.lit("")) for p in (r"(?:const|let|var|import)\s+\{?\s*(\w+)[^=]*?\}?\s*(?:=\s*require\(|from\s+)['\"]([^'\"./][^'\"]*)['\"]", r"^\s*(from|import)\s+(\w+)")]).alias("package"),
        F.coalesce(F.nullif(F.regexp_extract("line", r"(?:const|let|var|import)\s+\{?\s*(\w+)", 1), F.lit("")), F.regexp_extract("line", r"^\s*(?:from|import)\s+(\w+)", 1)).alias("alias"),
    ).where("package is not null")
    imp = imp.join(dependencies.select("package"), "package", "left_semi")
    called = l.select("path", F.explode(F.regexp_extract_all("line", F.lit(r"(\w+)(?:\.(\w+))?\s*\("), F.lit(0))).alias("c")).select("path", F.regexp_extract("c", r"^(\w+)", 1).alias("alias"), F.regexp_extract("c", r"\.(\w+)", 1).alias("function")).distinct()
    used = imp.join(called, ["path", "alias"]).join(functions, "package", "left").withColumn("hit", (functions["function"] == called["function"]) | (functions["function"] == F.col("alias")))
    exposed = l.groupBy("path").agg(F.bool_or(F.col("line").rlike(r"req\.(query|body|params)|request\.|app\.(get|post|use)\(")).alias("exposed"))
    rung = used.join(exposed, "path").groupBy("package").agg(F.max(F.when(F.col("hit") & F.col("exposed"), 3).when(F.col("hit"), 2).otherwise(1)).alias("r"))
    rung = rung.unionByName(imp.select("package", F.lit(1).alias("r"))).groupBy("package").agg(F.max("r").alias("r"))
    out = dependencies.join(rung, "package", "left")
    return out.select("package", "version", F.element_at(F.array(*map(F.lit, LADDER)), F.coalesce("r", F.lit(0)) + 1).alias("exploitability"))
