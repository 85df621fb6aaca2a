"""Hundreds of rules over whole texts: what a pattern needs literally is searched for before the pattern is tried.

Of every pattern the factors are taken: literals of which any match holds one. One Aho-Corasick pass over a text finds
the factors of all rules and with them the lines and rules in question; only there are the patterns tried, in the JVM,
as literals that compile once. Patterns without a factor are tried on every line, so the result is that of trying all.
No shuffle; the automaton is as large as the rules and is built once per worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from re import _constants as P
from re import _parser

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .textscan import Rule

#: A factor has at least so many characters, and a pattern at most so many factors; others are tried everywhere.
LEAST, MOST = 3, 16
#: Bytes of lines in question that a worker holds before it passes them on.
HELD = 1 << 20

_REPEATS = (P.MAX_REPEAT, P.MIN_REPEAT, P.POSSESSIVE_REPEAT)


def _plain(text: str) -> str:
    """A to Z lower-cased, nothing else: what the JVM's (?i) takes as equal."""
    return text.encode().lower().decode()


def _parts(items):
    """In order: a character that must follow, alternatives of which one must be there, or None where anything may be."""
    for op, arg in items:
        if op is P.LITERAL and 32 <= arg != 127:
            yield chr(arg)
        elif op is P.SUBPATTERN:
            yield from _parts(arg[3])
        elif op is P.ATOMIC_GROUP:
            yield from _parts(arg)
        elif op in _REPEATS and arg[0] > 0:
            yield _best(arg[2])
        elif op is P.BRANCH:
            each = [_best(b) for b in arg[1]]
            yield frozenset().union(*each) if all(each) else None
        else:
            yield None


def _best(items) -> frozenset[str] | None:
    options, run = [], ""
    for p in [*_parts(items), None]:
        if isinstance(p, str):
            run += p
            continue
        options += [frozenset([_plain(run)])] if run else []
        options += [p] if p else []
        run = ""
    fit = [o for o in options if min(map(len, o)) >= LEAST and len(o) <= MOST]
    return max(fit, key=lambda o: (min(map(len, o)), -len(o)), default=None)


def _same_dialect(pattern: str) -> bool:
    """False where the JVM may read the pattern otherwise than the parser here: classes in classes, flags x and u."""
    inside = [re.sub(r"(?s)\\.", "", c) for c in re.findall(r"(?s)\\.|\[\^?(\]?(?:\\.|[^\]\\])*)", pattern)]
    return not any("[" in c or "&&" in c for c in inside) and not re.search(r"\(\?[a-zA-Z-]*[xuU]", pattern)


def factors(pattern: str) -> frozenset[str] | None:
    """Lower-cased literals of which every match of ``pattern`` holds one, or None if none can be told."""
    if not _same_dialect(pattern):
        return None
    try:
        return _best(_parser.parse(re.sub(r"^(\(\?i\))+", "", pattern)))
    except (re.error, OverflowError, RecursionError):
        return None


@lru_cache(maxsize=4)
def _automaton(needs: tuple[tuple[str, tuple[int, ...]], ...]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, rules in needs:
        a.add_word(word, rules)
    a.make_automaton()
    return a


def _search(rules: list[Rule], held: int):
    """Batches of (kept columns, text) to rows of (kept columns, line_number, line, _try), a few texts at a time."""
    found = [factors(r.pattern) for r in rules]
    always = frozenset(i for i, f in enumerate(found) if f is None)
    words = sorted(set().union(*(f for f in found if f)))
    needs = tuple((w, tuple(i for i, f in enumerate(found) if f and w in f)) for w in words)

    def one(t: str) -> list[tuple[int, str, list[int]]]:
        b, l = _plain(t), t.split("\n")
        ends = np.array([m.start() for m in re.finditer("\n", b)], dtype=np.int64)
        at: dict[int, set[int]] = {i: set(always) for i in range(len(l))} if always else {}
        hits = list(_automaton(needs).iter(b)) if needs else []
        for pos, (_, which) in zip(np.searchsorted(ends, [e for e, _ in hits]).tolist(), hits, strict=True):
            at.setdefault(pos, set()).update(which)
        return [(p + 1, l[p], sorted(r)) for p, r in sorted(at.items())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = None
        rows, some, size = [], [], 0

        def out(b: pa.RecordBatch) -> pa.RecordBatch:
            number, line, each = zip(*some) if some else ((), (), ())
            cols = [c.take(pa.array(rows, pa.int64())) for c in b.columns[:-1]]
            return pa.RecordBatch.from_arrays([*cols, pa.array(number, pa.int64()), pa.array(line, pa.string()), pa.array(each, pa.list_(pa.int32()))], names)

        for b in batches:
            names = [*b.schema.names[:-1], "line_number", "line", "_try"]
            for i, t in enumerate(b.column(b.num_columns - 1)):
                if t.is_valid:
                    got = one(t.as_py())
                    some += got
                    rows += [i] * len(got)
                    size += sum(len(l) + 64 for _, l, _ in got)
                if size >= held:
                    yield out(b)
                    rows, some, size = [], [], 0
            if some:
                yield out(b)
                rows, some, size = [], [], 0

    return run


def in_question(texts: DataFrame, key: str, text: str, rules: list[Rule], language: str | None = None, held: int = HELD) -> DataFrame:
    """(key, line_number from 1, line, _try): the lines on which some pattern has to be tried, and which."""
    kept = texts.select(key, *([language] if language else []))
    schema = StructType([*kept.schema.fields, *StructType.fromDDL("line_number long, line string, _try array<int>").fields])
    return texts.select(*kept.columns, F.col(text).cast("string").alias("_t")).mapInArrow(_search(rules, held), schema)


def scan(texts: DataFrame, key: str, text: str, rules: list[Rule], language: str | None = None, chunk: int = 25) -> DataFrame:
    """(key, line_number, line, rule_id, severity, category), one row per line and matching rule; equal to textscan.scan.

    ``language`` names a column: a rule of another language does not apply. A null text has no lines, no rules no rows.
    Rules are told apart by place: two with one id give two rows.
    """
    lined = in_question(texts, key, text, rules, language)

    def test(i: int, r: Rule) -> Column:
        t = F.array_contains("_try", i) & F.col("line").rlike(r.regex)
        return F.when(t & (F.col(language) == r.language) if language and r.language != "*" else t, F.lit(i))

    def part(at: int) -> Column:
        some = F.filter(F.array(*[test(i, r) for i, r in enumerate(rules[at : at + chunk], at)]), lambda x: x.isNotNull())
        return F.when(F.exists("_try", lambda x: (x >= at) & (x < at + chunk)), some).otherwise(F.array().cast("array<int>"))

    none = F.array().cast("array<int>")
    found = lined.withColumn("_hit", F.explode(F.concat(none, *[part(i) for i in range(0, len(rules), chunk)])))
    about = lambda name: F.element_at(F.array(F.lit(""), *[F.lit(getattr(r, name)) for r in rules]), F.col("_hit") + 2).alias(name if name != "id" else "rule_id")
    return found.select(key, "line_number", "line", about("id"), about("severity"), about("category"))
