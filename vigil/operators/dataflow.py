"""Taint within and between functions, over lines of code (path, line_number, line).

A value is a node (path, at, name): the variable that line ``at`` assigns, a parameter of the function that begins at
``at``, what that function returns (name ``return``), or a sink of line ``at`` (name ``!kind``). An expression leads from the
definitions that reach it to the node it feeds, and lets a kind of taint pass unless a sanitizer of that kind stands in it.
The definition that reaches a use is the last one before it in its function (an as-of window per variable), so a variable
that is assigned again is clean from there on. Arguments lead to parameters and returned values to the calls' expressions.

Facts (node, kind) then spread along the edges. Evaluation is semi-naive: a round joins only the facts that the round
before found, and keeps those not known yet, so there are as many rounds as edges on the longest shortest chain.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .iterate import cut, drop
from .programs import CALL, DEFINITION, MODULE, NOT_CALLED, _events, parameters
from .taint import DECAY, SANITIZERS, SINKS, SOURCES

KINDS = tuple(SINKS)
RETURN = "return"
#: const/let/var or a type before it, ``$`` of PHP, more targets after a comma, a type after a colon, ``=`` or ``:=``.
ASSIGNMENT = r"^\s*(?:(?:const|let|var|final)\s+)?(?:[A-Za-z_][\w<>\[\].]*\s+)?\$?(\w+)(?:\s*,\s*\$?\w+)*\s*(?::[^=]+)?:?=(?![=>])\s*(.+)$"
#: Strings (escapes inside, open ones to the end), heads of calls, brackets, commas, all else.
TOKENS = r"""(?sU)"(?:\\.|[^"\\])*+(?:"|\\?\z)|'(?:\\.|[^'\\])*+(?:'|\\?\z)|`(?:\\.|[^`\\])*+(?:`|\\?\z)|[\w.]+\s*\(|[(),]|[^"'`(),\w]+|[\w.]+"""
#: Arguments of a call that count.
MOST_ARGUMENTS = 10
#: Tables of facts that are kept apart; so many become one.
TABLES = 8

_FRAME = "struct<name:string,head:string,raw:string,arg:string,args:array<string>>"
_CALLS = "array<struct<callee:string,args:array<string>>>"


def call_arguments(line: Column) -> Column:
    """Array of (callee, args) of all calls of a line: arguments as written, split at commas outside of brackets and strings.

    One fold over the tokens of the line keeps a stack of open brackets. Empty arguments are left out, a call that the line
    does not close has the arguments that a comma ends, and words that only look like calls are no callees.
    """
    tokens = F.regexp_extract_all(line, F.lit(TOKENS), F.lit(0))
    frames = lambda *x: F.array(*x).cast(f"array<{_FRAME}>")
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    closed = lambda top, more: F.concat(top["args"], F.when(more & (bare(top["arg"]) != ""), F.array(bare(top["arg"]))).otherwise(F.array().cast("array<string>")))
    found = lambda top, args: F.when(top["name"] != "", F.array(F.struct(top["name"].alias("callee"), F.slice(args, 1, MOST_ARGUMENTS).alias("args")))).otherwise(F.array().cast(_CALLS))

    def grown(stack: Column, text: Column) -> Column:
        """The stack with text added to what stands in its top bracket."""
        top = F.element_at(stack, -1)
        more = F.struct(top["name"].alias("name"), top["head"].alias("head"), F.concat(top["raw"], text).alias("raw"), F.concat(top["arg"], text).alias("arg"), top["args"].alias("args"))
        return F.when(F.size(stack) > 0, F.concat(F.slice(stack, F.lit(1), F.size(stack) - 1), frames(more))).otherwise(stack)

    def step(acc: Column, t: Column) -> Column:
        stack, out = acc["stack"], acc["out"]
        top, below = F.try_element_at(stack, F.lit(-1)), F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))
        name = bare(F.regexp_replace(t, r"\($", ""))
        empty = F.lit("")
        pushed = F.concat(stack, frames(F.struct(F.when(F.substring_index(name, ".", -1).isin(*NOT_CALLED), empty).otherwise(name).alias("name"), t.alias("head"), empty.alias("raw"), empty.alias("arg"), F.array().cast("array<string>").alias("args"))))
        comma = F.concat(below, frames(F.struct(top["name"].alias("name"), top["head"].alias("head"), F.concat(top["raw"], t).alias("raw"), empty.alias("arg"), closed(top, F.lit(True)).alias("args"))))
        inside = F.size(stack) > 0
        opens = t.endswith("(") & ~t.rlike("^[\"'`]")  # no string
        new_stack = F.when(opens, pushed).when(~inside, stack).when(t == ")", grown(below, F.concat(top["head"], top["raw"], F.lit(")")))).when(t == ",", comma).otherwise(grown(stack, t))
        new_out = F.when((t == ")") & inside, F.concat(out, found(top, closed(top, F.lit(True))))).otherwise(out)
        return F.struct(new_stack.alias("stack"), new_out.alias("out"))

    start = F.struct(F.array().cast(f"array<{_FRAME}>").alias("stack"), F.array().cast(_CALLS).alias("out"))
    end = lambda acc: F.concat(acc["out"], F.flatten(F.transform(acc["stack"], lambda top: found(top, top["args"]))))
    return F.when(line.contains("("), F.aggregate(tokens, start, step, end)).otherwise(F.array().cast(_CALLS))


def scoped(lined: DataFrame, definition: str = DEFINITION) -> DataFrame:
    """(path, line_number, line, function, start): the function each line lies in and the line where it begins (0: none).

    A definition belongs to the function that it opens, even if it closes it too.
    """
    begins = F.when(F.col("name").isNotNull(), F.col("line_number"))
    return _events(lined, definition).where("kind = 2").select("path", "line_number", "line", F.coalesce("name", "top", F.lit(MODULE)).alias("function"), F.coalesce(begins, "opened", F.lit(0)).cast("long").alias("start"))


def _far(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the code: always shuffled. Its files are so small, as names repeat, that the plan would
    send all rows through the driver to every executor."""
    return df.hint("merge")


def _passes(text: Column) -> Column:
    """The kinds of taint that no sanitizer in ``text`` stops."""
    return F.filter(F.array(*[F.when(~text.rlike(SANITIZERS.get(k, "(?!)") + "|" + SANITIZERS["any"]), F.lit(k)) for k in KINDS]), lambda k: k.isNotNull())


def expressions(code: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of scoped() lines: expressions (path, start, line_number, text, at, name, passes) with the node each feeds, and
    definitions (path, start, line_number, variable, defines) of assignments (1) and parameters (-1)."""
    bare = F.regexp_replace("line", r"^\s+", "")
    c = code.where(~bare.rlike(r"^(#|//|/\*)")).withColumn("target", F.nullif(F.regexp_extract("line", ASSIGNMENT, 1), F.lit(""))).withColumn("calls", call_arguments(F.col("line")))
    head = c.where((F.col("start") == F.col("line_number")) & (F.col("start") > 0)).select("path", "start", "line_number", "function", F.posexplode(parameters(F.col("line"))).alias("place", "variable"))
    last = head.select("path", "function", "start").union(c.where("start > 0").select("path", "function", "start")).groupBy("path", "function").agg(F.max("start").alias("callee_start"))
    part = lambda d, text, at, name, passes=None: d.select("path", "start", "line_number", text.alias("text"), at.alias("at"), name.alias("name"), (_passes(text) if passes is None else passes).alias("passes"))
    here = F.col("line_number")
    value = F.regexp_extract("line", ASSIGNMENT, 2)
    out = [part(c.where("target is not null"), value, here, F.col("target")), part(c.where(r"line rlike '^\\s*return\\b'"), F.regexp_extract("line", r"\breturn\b(.*)", 1), F.col("start"), F.lit(RETURN))]
    args = c.select("path", "start", "line_number", F.explode("calls").alias("call")).select("path", "start", "line_number", F.col("call.callee").alias("function"), F.posexplode("call.args").alias("place", "text"))
    args = args.join(_far(last), ["path", "function"]).join(_far(head.select("path", F.col("start").alias("callee_start"), "place", "variable")), ["path", "callee_start", "place"])
    out.append(part(args, F.col("text"), F.col("callee_start"), F.col("variable")))
    for kind, (pattern, *_) in SINKS.items():
        rest = F.regexp_extract("line", f"(?:{pattern})(.*)", 1)
        bound = F.lit(kind == "sql") & rest.rlike(r"[?%]s?['\"]\s*,")
        out.append(part(c.where(F.col("line").rlike(pattern) & ~bound), rest, here, F.lit(f"!{kind}"), F.array_intersect(_passes(rest), F.array(F.lit(kind)))))
    made = c.where("target is not null").select("path", "start", "line_number", F.col("target").alias("variable"), F.lit(1).alias("defines"))
    return reduce(DataFrame.union, out), made.union(head.select("path", "start", "line_number", "variable", F.lit(-1)))


def edges(code: DataFrame, between: bool = True) -> tuple[DataFrame, DataFrame]:
    """Edges (path, from_at, from_name, at, name, passes), and the nodes (path, at, name, passes, line_number) that a source
    feeds; ``between`` follows calls and returns."""
    found, defined = expressions(code)
    found = cut(found if between else found.where(F.col("name").startswith("!") | (F.col("at") == F.col("line_number"))))
    words = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_]\w*"), F.lit(0))))
    none = lambda t: F.lit(None).cast(t)
    uses = found.select("path", "start", words.alias("variable"), "line_number", F.lit(0).alias("defines"), "at", "name", "passes")
    defs = defined.distinct().select("path", "start", "variable", "line_number", "defines", none("long"), none("string"), none("array<string>"))
    before = Window.partitionBy("path", "start", "variable").orderBy("line_number", "defines").rowsBetween(Window.unboundedPreceding, -1)
    # on one line: parameters, then uses, then the assignment
    reach = uses.union(defs).withColumn("from_at", F.last(F.when(F.col("defines") != 0, F.col("line_number")), ignorenulls=True).over(before)).where("defines = 0 and from_at is not null")
    out = reach.select("path", "from_at", F.col("variable").alias("from_name"), "at", "name", "passes")
    if between:
        starts = code.where("start > 0").groupBy("path", "function").agg(F.max("start").alias("from_at"))
        called = found.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(CALL), F.lit(1)))).alias("function"), "at", "name", "passes")
        out = out.union(called.join(_far(starts), ["path", "function"]).select("path", "from_at", F.lit(RETURN), "at", "name", "passes"))
    fed = found.where(F.col("text").rlike("|".join(SOURCES.values()))).select("path", "at", "name", "passes", "line_number")
    out = cut(out.where(F.size("passes") > 0).groupBy("path", "from_at", "from_name", "at", "name").agg(F.array_distinct(F.flatten(F.collect_set("passes"))).alias("passes")))
    fed = cut(fed)
    drop(found)
    return out, fed


def spread(links: DataFrame, fed: DataFrame) -> DataFrame:
    """(path, at, name, kind, hops, source_line): the facts that hold, with the fewest edges from a source and the first
    line among the sources that are so near."""
    key = ["path", "at", "name", "kind"]
    new = cut(fed.select("path", "at", "name", F.explode("passes").alias("kind"), F.col("line_number").alias("source_line")).groupBy(*key).agg(F.lit(0).alias("hops"), F.min("source_line").alias("source_line")))
    parts, hops = [new], 0
    while not new.isEmpty():
        hops += 1
        from_new = new.select("path", F.col("at").alias("from_at"), F.col("name").alias("from_name"), "kind", "source_line")
        step = links.join(_far(from_new), ["path", "from_at", "from_name"]).where(F.array_contains("passes", F.col("kind"))).groupBy(*key).agg(F.lit(hops).alias("hops"), F.min("source_line").alias("source_line"))
        known = reduce(DataFrame.union, [p.select(*key) for p in parts])
        new = cut(step.join(_far(known), key, "left_anti"))
        if len(parts) == TABLES:
            whole = cut(reduce(DataFrame.union, parts))
            drop(*parts)
            parts = [whole]
        parts.append(new)
    return reduce(DataFrame.union, parts)


def flows(lined: DataFrame, definition: str = DEFINITION, between: bool = True) -> DataFrame:
    """(path, function, sink_line, kind, cwe, severity, source_line, hops, confidence) of every tainted sink.

    The confidence falls by a fixed factor with each edge after the first: a source that stands in the sink itself, or one
    edge away, is certain.
    """
    code = cut(scoped(lined, definition))
    links, fed = edges(code, between)
    facts = spread(links, fed).where(F.col("name").startswith("!"))
    at = lambda i: reduce(lambda c, kv: c.when(F.col("kind") == kv[0], kv[1][i]), SINKS.items(), F.when(F.lit(False), ""))
    where = code.select("path", F.col("line_number").alias("at"), "function")
    out = facts.join(_far(where), ["path", "at"]).select("path", "function", F.col("at").alias("sink_line"), "kind", at(1).alias("cwe"), at(2).alias("severity"), "source_line", "hops")
    return out.withColumn("confidence", F.round(F.pow(F.lit(DECAY), F.greatest(F.col("hops") - 1, F.lit(0))), 6))
