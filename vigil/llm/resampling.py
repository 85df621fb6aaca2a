"""Target-distribution importance resampling: documents are drawn by how much their n-grams look like a target corpus.

Features are all runs of one to three words, hashed to ``BUCKETS`` counts of the whole corpus and of the target. A bucket's
gain is the scaled, floored log ratio of its smoothed shares; a document weighs the sum of its features' gains, and a
Gumbel number from the hash of its id is added, so that the highest scores are a draw without replacement.

The weights are an array of ``BUCKETS`` numbers (the only thing broadcast); a text is scored by one gather from it. Scored
rows are sorted within their partition and written: one run per partition. A regular sample of the runs (``SAMPLES`` rows,
and one per run) gives splitters; the rows of every range between two splitters are counted exactly, and only ranges that
begin before the draw count are shuffled. Each of these is merged from its runs by a tournament tree that stops when the
count is reached. A range holds a bounded number of rows, whatever the ties: the last part of the key is the row's place in
its run. Ranks follow from the counts of the ranges before; no row outside the drawn ranges is moved.

Defined cases: null or empty text has no features, weight 0, and is not drawn; a null doc_id hashes as the empty id and
comes after all others of its score; rows that repeat an id are separate, ties between them go by features, weight and
place; texts of any length are read whole; an empty table gives no rows; an empty target gives weights against no counts
(all T and t are 0); columns but doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .licenses import words

BUCKETS = 10_000
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
#: Rows that the driver gets to choose splitters (besides one per run), and rows that a merged range has about, if not fewer than a sample stands for.
SAMPLES, RANGE = 50_000, 200_000
#: Words that are hashed at once; bounds the memory of a long text.
CHUNK = 1 << 20


def features(text: bytes) -> Iterator[np.ndarray]:
    """Bucket numbers of all runs of one to three words, in one or more arrays."""
    ws = words(text)
    for at in range(0, len(ws), CHUNK):
        mine = ws[at : at + CHUNK + 2]
        after = [b" " + w for w in mine]
        one = [*map(crc32, mine)]
        two = [*map(crc32, after[1:], one)]
        three = [*map(crc32, after[2:], two)]
        yield np.array(one[:CHUNK] + two[:CHUNK] + three[:CHUNK], dtype=np.int64) % BUCKETS


def counts(texts: DataFrame) -> np.ndarray:
    """How many features of all ``texts`` (text) fall in each bucket: one array per task, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            for t in C.text_bytes(b.column(0)):
                for f in features(t):
                    total += np.bincount(f, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    got = texts.selectExpr("cast(text as string) text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows at most
    out = np.zeros(BUCKETS, dtype=np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored, scaled log ratio of the smoothed shares of every bucket."""
    s_all, t_all = float(corpus.sum()), float(target.sum())
    ratio = lambda s, t: (t + 1.0) * (s_all + BUCKETS) / ((s + 1.0) * (t_all + BUCKETS))
    return np.array([math.floor(1000 * math.log(ratio(float(s), float(t)))) for s, t in zip(corpus, target, strict=True)], dtype=np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """The Gumbel number of a document, scaled and floored."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(documents: DataFrame, gain: np.ndarray, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, eligible) for every row."""
    enough = sum(max(least - k, 0) for k in range(3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, w = [], []
            for t in C.text_bytes(b.column(1)):
                found = [(len(f), int(gain[f].sum())) for f in features(t)]
                n.append(sum(x for x, _ in found))
                w.append(sum(x for _, x in found))
            score = [x + noise(i, seed) for i, x in zip(b.column(0).to_pylist(), w, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (n, w, score)), pa.array([x >= enough for x in n], pa.bool_())], ["doc_id", "n_features", "weight", "score", "eligible"])

    docs = documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return docs.mapInArrow(run, "doc_id long, n_features long, weight long, score long, eligible boolean")


def tournament(runs: list[Iterable[tuple]]) -> Iterator[tuple]:
    """The items of sorted runs in order: a tree of winners over the runs' heads, of which each step replays one path."""
    k, its = len(runs), [iter(r) for r in runs]
    heads = [next(i, None) for i in its]

    def winner(a: int, b: int) -> int:
        return a if heads[b] is None or heads[a] is not None and heads[a] < heads[b] else b

    tree = [0] * k + [*range(k)]
    for i in range(k - 1, 0, -1):
        tree[i] = winner(tree[2 * i], tree[2 * i + 1])
    while k and heads[tree[1]] is not None:
        w = tree[1]
        yield heads[w]
        heads[w], i = next(its[w], None), (w + k) // 2
        while i:
            tree[i] = winner(tree[2 * i], tree[2 * i + 1])
            i //= 2


_COLUMNS = ("score", "doc_id", "n_features", "weight", "at")
_LAST = 1 << 63  # after every id


def _keys(b: pa.RecordBatch) -> list[tuple]:
    """Sort keys of a batch's rows, the best first."""
    score, doc, n, w, at = (b.column(b.schema.get_field_index(c)).to_pylist() for c in _COLUMNS)
    return [(-s, _LAST if d is None else d, x, y, z) for s, d, x, y, z in zip(score, doc, n, w, at, strict=True)]


def draw(scored: DataFrame, percent: int = PERCENT, samples: int = SAMPLES, rows: int = RANGE) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of weigh(): rank 1, 2, 3, ... of the floor(percent * N / 100)
    highest scores of the N eligible rows, null for all others."""
    spark, out = scored.sparkSession, "doc_id long, n_features long, weight long, score long, rank long"
    names = ["doc_id", "n_features", "weight", "score"]
    order = [F.desc("eligible"), F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight"]
    runs = C.cut(scored.sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))  # at: the run above 33 bits, the place in it below
    able = runs.where("eligible")
    n = able.count()
    m = percent * n // 100
    if m == 0:
        return runs.select(*names, F.lit(None).cast("long").alias("rank"))
    every = max(1, n // samples)
    place = F.col("at").bitwiseAND((1 << 33) - 1)
    found = able.where(place % every == 0).select(*_COLUMNS).toArrow()  # n / every rows, and one per run
    keys = sorted(k for b in found.to_batches() for k in _keys(b))
    splitters = keys[max(1, rows // every) :: max(1, rows // every)]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = [bisect_right(splitters, k) if e else len(splitters) + 1 for k, e in zip(_keys(b), b.column(b.schema.get_field_index("eligible")).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(r, pa.int64())], [*b.schema.names, "range"])

    ranged = runs.mapInArrow(number, runs.selectExpr("*", "0L range").schema)
    sizes = dict(ranged.where("eligible").groupBy("range").count().collect())  # samples rows at most
    before, total = {}, 0
    for r in range(len(splitters) + 1):
        if total < m:
            before[r] = total
        total += sizes.get(r, 0)

    def ranked(b: pa.RecordBatch) -> pa.RecordBatch:
        """One range, its rows by run and place."""
        keys, at = _keys(b), b.column(b.schema.get_field_index("at")).to_numpy() >> 33
        edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
        merged = tournament([zip(keys[x:y], range(x, y)) for x, y in zip(edges, edges[1:], strict=False)])
        first = before[b.column(b.schema.get_field_index("range"))[0].as_py()]
        rank: list[int | None] = [None] * len(keys)
        for r, (_, i) in zip(range(first + 1, m + 1), merged, strict=False):  # ends with the draw count
            rank[i] = r
        return pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(rank, pa.int64())], [*names, "rank"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            r = b.column(b.schema.get_field_index("range")).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(r)) + 1).tolist(), len(r)]
            for x, y in zip(edges, edges[1:], strict=False):
                part = b.slice(x, y - x)
                if held and part.num_rows and held[0].column(held[0].schema.get_field_index("range"))[0] != part.column(part.schema.get_field_index("range"))[0]:
                    yield ranked(pa.concat_batches(held))
                    held = []
                if part.num_rows:
                    held.append(part)
        if held:
            yield ranked(pa.concat_batches(held))

    last = max(before)
    drawn = ranged.where(F.col("range") <= last).repartition(max(len(before), 1), "range").sortWithinPartitions("range", "at").mapInArrow(merge, out)
    return drawn.union(ranged.where(F.col("range") > last).select(*names, F.lit(None).cast("long")))


def resample(documents: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """draw() of weigh(): ``documents`` (doc_id, text) towards the texts of ``target`` (text)."""
    return draw(weigh(documents, gains(counts(documents), counts(target)), least, seed), percent)
