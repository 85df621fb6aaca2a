"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Statistics of the whole text (shares of character classes, lengths, repetition of words, word pairs, lines) are
brought to the real line by logs and log-odds and standardised. Each class has a mean and a covariance, shrunk first
towards the pooled covariance and then towards a multiple of the identity. Its Cholesky factor is computed once; a
document's score is the posterior of class 1 from the difference of the Mahalanobis log densities.

Fitting reads at most ``sample`` labelled rows (those with the least hash of their id), never a held-out one.

Defined cases: null text is the empty text and gets the score of its statistics; labels that are null, or repeated
with both values, are not used; with no labelled row of a class the score is the share of class 1 among labels (1 if
there are none); null doc_id counts as not held out; texts of any length are read whole; ids with the same hash are
ordered by id; rows that repeat an id are scored each; keep() returns all columns, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SAMPLE = 20_000
SHRINK_POOLED, SHRINK_IDENTITY = 0.3, 0.05
FOLDS, FOLD = 5, 0
THRESHOLD = 0.3

_CLASS = np.zeros(256, dtype=np.int64)  # 0: other symbols
for _i, _s in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\v\f", b"\n", b".,;:'\"?-()", b"!"), 1):
    _CLASS[np.frombuffer(_s, dtype=np.uint8)] = _i
_CLASS[128:] = 8


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of one text; finite for every text."""
    n = len(text)
    h = np.bincount(_CLASS[np.frombuffer(text, dtype=np.uint8)], minlength=9)
    letters = h[1] + h[2] + h[8]
    words = text.split()
    m = len(words)
    low = [w.strip(b".,;:!?\"'()").lower() for w in words]
    counts = Counter(low)
    top = max(counts.values(), default=0)
    same = sum(a == b for a, b in zip(low, low[1:]))
    pairs = len(set(zip(low, low[1:]))) if m > 1 else 0
    fives = len(set(zip(low, low[1:], low[2:], low[3:], low[4:]))) if m > 4 else 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    stops = text.count(b".") + text.count(b"?") + text.count(b"!")
    odds = lambda a, b: float(np.log((a + 0.5) / (max(b - a, 0) + 0.5)))
    ends = sum(w[-1] in b"#$%&*|~^_=+<>@" for w in words)
    return [
        float(np.log1p(m)),
        float(np.log((n + 1) / (m + 1))),
        odds(h[0], n), odds(h[2], letters), odds(h[3], n), odds(h[6], n), odds(h[7], n),
        odds(letters, n), odds(h[8], letters),
        odds(len(counts), m), odds(top, m), odds(same, m), odds(pairs, m), odds(fives, m),
        odds(len(set(lines)), len(lines)), float(np.log1p(len(lines))),
        float(np.log((m + 1) / (stops + 1))), odds(ends, m),
    ]


class Discriminant:
    """score() gives the posterior of class 1."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pooled: float = SHRINK_POOLED, identity: float = SHRINK_IDENTITY):
        self.prior = float(y.mean()) if len(y) else 1.0
        self.parts = None
        if len(y) == 0 or y.min() == y.max():
            return
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = (x - self.mean) / self.scale
        means = [z[y == c].mean(axis=0) for c in (0, 1)]
        covs = [(d := z[y == c] - means[c]).T @ d for c in (0, 1)]
        shared = (covs[0] + covs[1]) / len(y)
        self.parts = []
        for c in (0, 1):
            n = int((y == c).sum())
            a = max(pooled, z.shape[1] / (z.shape[1] + n))
            cov = (1 - a) * covs[c] / n + a * shared
            cov = (1 - identity) * cov + identity * np.eye(len(cov)) * max(np.trace(cov) / len(cov), 1e-3)
            chol = np.linalg.cholesky(cov)
            self.parts.append((means[c], np.linalg.inv(chol), 2 * np.log(np.diag(chol)).sum(), np.log(n / len(y))))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.parts is None:
            return np.full(len(x), self.prior)
        z = (x - self.mean) / self.scale
        d = [lp - 0.5 * ((((z - m) @ inv.T) ** 2).sum(axis=1) + logdet) for m, inv, logdet, lp in self.parts]
        return 1 / (1 + np.exp(np.clip(d[0] - d[1], -700, 700)))


def labelled(documents: DataFrame, labels: DataFrame, column: str, sample: int, folds: int = FOLDS, fold: int = FOLD) -> DataFrame:
    """(text, y) of at most ``sample`` documents outside the held-out fold; the ids, not the texts, are broadcast.

    Of rows that repeat an id, the one whose text has the least hash is taken, so ``sample`` bounds the rows as well.
    """
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    y = y.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top").where(~C.held_out("doc_id", folds, fold))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", "y")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = docs.join(F.broadcast(y), "doc_id")  # `sample` ids at most
    return rows.groupBy("doc_id").agg(F.min_by(F.struct("text", "y"), F.xxhash64("text")).alias("row")).select("row.text", "row.y")


def fit(documents: DataFrame, labels: DataFrame, column: str = "quality", sample: int = SAMPLE, pooled: float = SHRINK_POOLED, identity: float = SHRINK_IDENTITY) -> Discriminant:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t) for t in C.text_bytes(b.column(0))]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

    rows = C.arrow(labelled(documents, labels, column, sample), run, "y int, x array<double>").toArrow()
    y = rows.column("y").to_numpy()
    x = np.array(rows.column("x").to_pylist(), dtype=float).reshape(len(y), len(statistics(b"")))
    return Discriminant(x, y, pooled, identity)


def score(documents: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in C.text_bytes(b.column(1))], dtype=float)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x) if len(x) else [], pa.float64())], ["doc_id", "score"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = C.arrow(docs, run, "doc_id long, score double")
    return out.select("doc_id", C.held_out("doc_id", FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(documents: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents``, all columns, whose score reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in C.text_bytes(b.column(b.schema.get_field_index("text")))], dtype=float)
            if len(x):
                yield b.filter(pa.array(model.score(x) >= threshold))

    return C.arrow(documents, run, documents.schema)
