"""Structure of programs from lines (path, line_number, line): scopes, calls, control flow, data flow, summaries.

Everything is a window over the lines of a file or an equi-join on (path, name) or (path, line_number); no file is handed
to one function. The stack of open functions is a running sum that never falls below zero: a line opens a function by
its definition and closes one where no brace is open, so depth = sum - min(0, least sum so far). What is open at
a depth is the last function opened at that depth.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .iterate import parts
from .taint import SANITIZERS, SINKS, SOURCES

# The definition pattern for any language, call sites, words that look like calls, classes of lines.
DEFINITION = r"(?:function|def|func)\s+(\w+)"
CALL = r"(\w+(?:\.\w+)*)\s*\("
NOT_CALLED = (
    "if", "for", "while", "switch", "catch", "function", "class", "return", "func", "def", "else", "elif", "try", "except", "finally", "with",
    "new", "delete", "typeof", "instanceof", "import", "export", "from", "go", "select", "case", "default", "range", "defer", "panic", "recover",
    "public", "private", "protected", "static", "final", "abstract", "throw", "throws", "async", "await", "yield",
)
LINE_CLASSES = (
    ("condition", r"^(?:if\s*\(|if\s+|else\s+if|elif\s+|switch\s*\()"), ("loop", r"^(?:for\s*\(|for\s+|while\s*\(|while\s+|do\s*\{)"),
    ("try", r"^try"), ("catch", r"^(?:catch|except|rescue|finally)"), ("return", r"^return "),
)
ASSIGNMENT = r"^\s*(\w+)\s*=\s*(.+)"
MODULE, ENTRY, EXIT = "<module>", 0, -1
#: Lines that a task sorts at once; each becomes up to three rows.
ROWS = 100_000


def deal(lines: DataFrame, path: str = "path", rows: int = ROWS) -> DataFrame:
    """``lines`` by file, dealt to as many partitions as their number asks for; the windows over a file then need no other shuffle."""
    return lines.repartition(parts(lines, rows), path)


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _count(c: Column, char: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def parameters(line: Column) -> Column:
    """Names in the first parentheses, without types after a colon, defaults, or starred ones."""
    inside = F.regexp_extract(line, r"\(([^)]*)\)", 1)
    names = F.transform(F.split(inside, ","), lambda p: F.trim(F.element_at(F.split(p, "[:=]"), 1)))
    return F.filter(names, lambda p: (p != "") & ~p.startswith("*"))


def _events(lined: DataFrame, definition: str) -> DataFrame:
    """One row per opening (kind 0), closing (1) and line (2), with the function on top and where it is closed."""
    by = Window.partitionBy("path").orderBy("line_number")
    far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = F.coalesce("line", F.lit(""))
    df = lined.select("path", F.col("line_number").cast("long").alias("line_number"), line.alias("line"), _some(F.regexp_extract(line, definition, 1)).alias("name"))
    opens = F.col("name").isNotNull().cast("int")
    df = df.withColumn("braces", F.sum(_count(F.col("line"), "{") - _count(F.col("line"), "}")).over(far))
    df = df.withColumn("sum", F.sum(opens - (F.col("braces") <= 0).cast("int")).over(far))
    df = df.withColumn("depth", F.col("sum") - F.least(F.lit(0), F.min("sum").over(far)))
    df = df.withColumn("high", F.lag("depth", 1, 0).over(by) + opens)
    none = F.lit(None).cast("int")
    at = [F.when(opens == 1, F.col("high")), F.when((F.col("braces") <= 0) & (F.col("high") > 0), F.col("high")).otherwise(none), F.col("depth")]
    df = df.withColumn("e", F.explode(F.array(*[F.struct(a.cast("long").alias("level"), F.lit(k).alias("kind")) for k, a in enumerate(at)]))).where("e.level is not null")
    df = df.select("path", "line_number", "line", "name", "e.level", "e.kind")
    same = Window.partitionBy("path", "level").orderBy("line_number", "kind")
    top = F.last(F.when(F.col("kind") == 0, F.col("name")), ignorenulls=True).over(same.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    closed = F.first(F.when(F.col("kind") == 1, F.col("line_number")), ignorenulls=True).over(same.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    opened = F.last(F.when(F.col("kind") == 0, F.col("line_number")), ignorenulls=True).over(same.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("top", top).withColumn("closed", closed).withColumn("opened", opened)


def functions(lined: DataFrame, definition: str = DEFINITION) -> DataFrame:
    """(path, name, start_line, end_line, line): every definition; one that is never closed ends where it starts."""
    return _events(lined, definition).where("kind = 0").select("path", "name", F.col("line_number").alias("start_line"), F.coalesce("closed", "line_number").alias("end_line"), "line")


def calls(lined: DataFrame, definition: str = DEFINITION) -> DataFrame:
    """(path, caller, callee, line_number) of every call site; outside of functions the caller is ``<module>``."""
    at = _events(lined, definition).where("kind = 2")
    each = at.select("path", "line_number", F.coalesce("top", F.lit(MODULE)).alias("caller"), F.explode(F.regexp_extract_all("line", F.lit(CALL), F.lit(1))).alias("callee"))
    return each.where(~F.element_at(F.split("callee", r"\."), -1).isin(*NOT_CALLED)).select("path", "caller", "callee", "line_number")


def control_flow(lined: DataFrame) -> DataFrame:
    """(path, src, dst, kind): edges between lines that are not blank, from entry (0) to exit (-1); kind is that of src.

    A return leads to the next line and to the exit. A file of blank lines leads from entry to exit.
    """
    bare = F.trim(F.regexp_replace(F.coalesce("line", F.lit("")), r"\s", " "))
    rows = lined.select("path", F.col("line_number").cast("long").alias("line_number"), bare.alias("bare"))
    kind = reduce(lambda c, x: c.when(F.col("bare").rlike(x[1]), x[0]), LINE_CLASSES, F.when(F.lit(False), "")).otherwise("statement")
    by = Window.partitionBy("path").orderBy("line_number")
    some = rows.where("bare <> ''").withColumn("kind", kind)
    some = some.withColumn("before", F.lag("line_number").over(by)).withColumn("after", F.lead("line_number").over(by))
    edge = lambda a, b, k: F.struct(a.alias("src"), b.alias("dst"), k.alias("kind"))
    here, out = F.col("line_number"), F.lit(EXIT).cast("long")
    edges = F.array(
        F.when(F.col("before").isNull(), edge(F.lit(ENTRY).cast("long"), here, F.lit("entry"))), F.when(F.col("after").isNotNull(), edge(here, F.col("after"), F.col("kind"))),
        F.when(F.col("after").isNull() | (F.col("kind") == "return"), edge(here, out, F.col("kind"))),
    )
    flow = some.select("path", F.explode(F.filter(edges, lambda e: e.isNotNull())).alias("e")).select("path", "e.*")
    blank = rows.groupBy("path").agg(F.max("bare").alias("m")).where("m = ''")
    return flow.union(blank.select("path", F.lit(ENTRY).cast("long"), out, F.lit("entry")))


def data_flow(lined: DataFrame, definition: str = DEFINITION) -> DataFrame:
    """(path, kind, variable, line_number, target): assignments, parameters, uses, and variables that a target depends on.

    Variables are those a file assigns or takes as parameters. The left side of an assignment is no use.
    """
    line = F.coalesce("line", F.lit(""))
    rows = lined.select("path", F.col("line_number").cast("long").alias("line_number"), line.alias("line"), _some(F.regexp_extract(line, ASSIGNMENT, 1)).alias("target"))
    none = F.lit(None).cast("string")
    made = rows.where("target is not null").select("path", F.lit("assignment").alias("kind"), F.col("target").alias("variable"), "line_number", none.alias("target"))
    taken = rows.where(F.col("line").rlike(definition)).select("path", F.lit("parameter").alias("kind"), F.explode(parameters(F.col("line"))).alias("variable"), "line_number", none.alias("target"))
    names = made.union(taken).select("path", "variable").distinct()
    words = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\w+)"), F.lit(1))))
    used = rows.select("path", "line_number", "target", words("line").alias("variable")).where("target is null or target <> variable").join(names, ["path", "variable"])
    value = F.regexp_extract("line", ASSIGNMENT, 2)
    needs = rows.where("target is not null").select("path", "target", words(value).alias("variable")).where("target <> variable").join(names, ["path", "variable"]).distinct()
    used = used.select("path", F.lit("use"), "variable", "line_number", none)
    return made.union(taken).union(used).union(needs.select("path", F.lit("dependency"), "variable", F.lit(None).cast("long"), "target"))


def summaries(lined: DataFrame, definition: str = DEFINITION) -> DataFrame:
    """(path, name, start_line, end_line, params, sinks, sanitizes, returns_tainted, calls_source) of every function.

    ``sinks`` lists parameter:sink where a parameter and a sink stand in one statement; ``sanitizes`` the kinds of its
    sanitizers. A return value is tainted by a parameter in it or by a source in the body.
    """
    f = functions(lined, definition).withColumn("params", parameters(F.col("line"))).drop("line")
    at = f.withColumn("line_number", F.explode(F.sequence("start_line", "end_line")))
    key, n = ["path", "name", "start_line", "end_line"], parts(lined, ROWS)
    text = lined.select("path", F.col("line_number").cast("long").alias("line_number"), F.coalesce("line", F.lit("")).alias("line"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_number", "line"))), lambda x: x["line"]), "\n")
    both = [d.repartition(n, "path", "line_number") for d in (at, text)]
    whole = both[0].join(both[1], ["path", "line_number"]).repartition(n, *key).groupBy(*key).agg(F.first("params").alias("params"), body.alias("body"))
    has = F.col("body").rlike

    def near(p: Column) -> Column:
        name = F.regexp_replace(p, r"(\W)", r"\\$1")
        tests = []
        for kind, (sink, *_) in SINKS.items():
            both = F.concat(F.lit(r"(?i)\b"), name, F.lit(rf"\b[^;{{}}]*(?:{sink})|(?:{sink})[^;{{}}]*\b"), name, F.lit(r"\b"))
            tests.append(F.when(F.regexp_like("body", both), F.concat(p, F.lit(f":{kind}"))))
        return F.filter(F.array(*tests), lambda x: x.isNotNull())

    sinks = F.array_join(F.array_sort(F.flatten(F.transform("params", near))), ",")
    clean = F.array_join(F.array_sort(F.filter(F.array(*[F.when(has(p), k) for k, p in SANITIZERS.items()]), lambda x: x.isNotNull())), ",")
    source = has("|".join(SOURCES.values()))
    returned = F.exists("params", lambda p: F.regexp_like("body", F.concat(F.lit(r"return\s+.*\b"), F.regexp_replace(p, r"(\W)", r"\\$1"), F.lit(r"\b"))))
    return whole.select(*key, F.array_join("params", ",").alias("params"), sinks.alias("sinks"), clean.alias("sanitizes"), (returned | source).alias("returns_tainted"), source.alias("calls_source"))
