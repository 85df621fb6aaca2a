"""Rules against lines of text.

Lines are exploded once. Rules are folded into one array expression per chunk of rules (each a literal pattern, so the
regex compiles once), which needs no join and no shuffle; only lines that match anything are kept. Patterns are
checked when rules are loaded: an invalid one is set aside instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Bytes that a worker hands over at once where a text gives many rows.
HELD = 1 << 20


@dataclass(frozen=True)
class Rule:
    id: str
    pattern: str
    severity: str = "medium"
    language: str = "*"
    category: str = "general"
    ignore_case: bool = True

    @property
    def regex(self) -> str:
        return ("(?i)" if self.ignore_case else "") + self.pattern


def valid_rules(spark: SparkSession, rules: list[Rule]) -> tuple[list[Rule], list[tuple[Rule, str]]]:
    """Rules whose pattern the engine compiles, and the others with the reason."""
    good, bad = [], []
    for r in rules:
        try:
            spark._jvm.java.util.regex.Pattern.compile(r.regex)
            good.append(r)
        except Exception as e:
            bad.append((r, str(e).splitlines()[0]))
    return good, bad


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_number from 1, line)."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).select(key, (F.col("pos") + 1).cast("long").alias("line_number"), "line")


def hits(line: Column, rules: list[Rule], language: Column | None = None) -> Column:
    """Array of the ids of rules that match; a rule of another language does not apply."""
    tests = []
    for r in rules:
        t = line.rlike(r.regex)
        if language is not None and r.language != "*":
            t = t & (language == r.language)
        tests.append(F.when(t, F.lit(r.id)))
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def scan(lined: DataFrame, rules: list[Rule], language: Column | None = None, chunk: int = 40) -> DataFrame:
    """Adds rule_id, severity and category: one row per line and matching rule.

    Chunks keep the generated code within the JVM's method size; each is a projection over the same scan.
    """
    found = F.concat(*[hits(F.col("line"), rules[i : i + chunk], language) for i in range(0, len(rules), chunk)])
    out = lined.withColumn("_hits", found).where(F.size("_hits") > 0).withColumn("rule_id", F.explode("_hits")).drop("_hits")
    for name in ("severity", "category"):
        value = reduce(lambda c, r: c.when(F.col("rule_id") == r.id, getattr(r, name)), rules, F.when(F.lit(False), ""))
        out = out.withColumn(name, value)
    return out


def context(df: DataFrame, key: str, text: str, before: int, after: int) -> DataFrame:
    """(key, line_number, line, context): neighbouring lines by slicing the array of lines, without a window."""
    a = df.select(key, F.split(text, "\n").alias("_l"))
    out = a.select(key, "_l", F.posexplode("_l").alias("pos", "line"))
    start = F.greatest(F.lit(1), F.col("pos") + 1 - before)
    size = F.least(F.size("_l"), F.col("pos") + 1 + after) - start + 1
    return out.select(key, (F.col("pos") + 1).cast("long").alias("line_number"), "line", F.array_join(F.slice("_l", start, size), "\n").alias("context"))


def carry(df: DataFrame, key: str, order: str, value: Column, name: str) -> DataFrame:
    """Last non-null value so far, in order: the current file of a diff, the section of a manifest."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def diff_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """Added lines of unified diffs with the file they belong to: (key, line_number, file, added)."""
    named = carry(lines(df, key, text), key, "line_number", F.when(F.col("line").startswith("+++ b/"), F.expr("substring(line, 7)")), "file")
    return named.where(F.col("line").startswith("+") & ~F.col("line").startswith("+++")).select(key, "line_number", "file", F.expr("substring(line, 2)").alias("added"))


def _pieces(t: str, lengths: Iterable[int]) -> Iterator[str]:
    return (t[i : i + n] for n in lengths for i in range(len(t) - n + 1))


def heads_in(texts: pd.Series, lengths: Iterable[int], known: frozenset[str]) -> pd.Series:
    """The known heads in each text; of a text's pieces no others are held."""
    return texts.map(lambda t: [*{g for g in _pieces(t or "", lengths) if g in known}])


def _cut_up(batches: Iterator[pa.RecordBatch], place: int, lengths: Iterable[int]) -> Iterator[pa.RecordBatch]:
    """Each row with all pieces of its text, as many at once as copies of the row fit into HELD bytes."""
    for b in batches:
        for i, t in enumerate(b.column(place)):
            every = [*set(_pieces(t.as_py() or "", lengths))]
            step = max(1, HELD // max(1, b.slice(i, 1).nbytes))
            for j in range(0, len(every), step):
                part = every[j : j + step]
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array([i] * len(part), pa.int64())) for c in b.columns), pa.array(part, pa.string())], [*b.schema.names, "_g"])


def contains_join(texts: DataFrame, text: str, values: DataFrame, value: str, gram: int = 6, most: int = 100_000) -> DataFrame:
    """texts rows with the values (not empty) that occur inside ``text``.

    A value can only start where the text has the value's head, its first ``gram`` characters (all of a shorter value), so
    an equi-join on heads finds all candidates and contains() decides; no product of texts and values. If there are at
    most ``most`` heads, the workers know them and only these leave the texts; beyond that, all pieces of the texts of the
    lengths that heads have are joined.
    """
    head = F.left(F.col(value), F.lit(gram))
    named = values.where(F.length(value) > 0)
    heads = named.select(head.alias("g")).distinct().limit(most + 1).collect()
    known = frozenset(r.g for r in heads) if len(heads) <= most else None
    lengths = sorted({len(g) for g in known}) if known is not None else range(1, gram + 1)

    if known is not None:
        pieces = F.pandas_udf(lambda s: heads_in(s, lengths, known), "array<string>")
        a = texts.withColumn("_g", F.explode(pieces(text)))
    else:
        place = texts.columns.index(text)
        a = texts.mapInArrow(lambda batches: _cut_up(batches, place, lengths), StructType([*texts.schema.fields, StructField("_g", StringType())]))
    b = named.withColumn("_g", head)
    return a.join(b, "_g").where(F.expr(f"contains(`{text}`, `{value}`)")).drop("_g").dropDuplicates()
