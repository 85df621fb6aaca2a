"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier.

Voters. Lexicon entries are whole words and word beginnings whose document frequencies differ between labels; they
are counted over the sample on the executors, and the strongest ``LEXICON`` come back. They are dealt to ``GROUPS``
voters for each kind of entry, each firing on any of its own words; further voters fire on one or two hits by kind of
entry and by strength; pattern voters look at exclamation, capitals and address. While training, a document's own
occurrence is taken out of the counts, so that an entry known from one document never explains it.

Label model. A two-class generative model of the votes: a mean vote per class (accuracies) and a shared covariance
(correlations), fitted by expectation maximisation that starts from the agreement of the voters (two means of the share
that fires) and re-estimates all of them, and the shares of the classes, each round. Correlated voters thus share their
weight. The given label is one more voter, of unknown accuracy. Classifier: ridge logistic regression of the posterior on
votes and hit counts; it alone scores documents.

Fitting reads at most ``sample`` labelled rows (those with the least hash of their id), never a held-out one.

Defined cases: null text is the empty text; with no labelled row of a class every score is 0; null doc_id counts as
not held out; rows that repeat an id are scored each; texts of any length are read whole; entries of equal strength are
taken in order of their key; keep() returns all columns, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .quality import labelled

SAMPLE = 20_000
LEXICON = 20_000
FOLDS, FOLD = 5, 0
THRESHOLD = 0.5
PREFIXES = (4, 5, 6)
TIERS = (1.5, 2.5, 3.5)
#: Voters that the entries of one kind are dealt to, by a hash of the word.
GROUPS = 8

_DROP = bytes(range(0x21, 0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x7F)) + b"0123456789"
_SPACES = bytes.maketrans(_DROP, b" " * len(_DROP))
#: Words of address: a public list of second-person forms in the four languages of the test tables.
ADDRESS = frozenset(["you", "your", "du", "dich", "dein", "tu", "toi", "ton", "te", "usted"])


def words(text: bytes) -> list[str]:
    return text.decode("utf-8", "replace").lower().encode().translate(_SPACES).decode().split()


def entries(word: str) -> list[str]:
    """Lexicon keys of a word: itself, marked by a blank, and its beginnings."""
    return [word + " ", *(word[:k] for k in PREFIXES if len(word) >= k)]


class Lexicon:
    """Log-odds of entries, with the counts they come from."""

    def __init__(self, table: dict[str, tuple[int, int]], positives: int, negatives: int):
        self.table, self.n1, self.n0 = table, positives, negatives
        self.cache: dict[tuple[str, int], tuple[float, ...]] = {}

    def odds(self, pos: int, neg: int, own: int) -> float:
        """own: 1 or 0, the label of the document that is looked at while training; -1 when scoring."""
        pos, neg = pos - (own == 1), neg - (own == 0)
        if pos < 2:
            return 0.0
        return float(np.log((pos + 0.3) / (self.n1 + 1)) - np.log((neg + 0.3 + 0.0005 * self.n0) / (self.n0 + 1)))

    def strength(self, word: str, own: int) -> tuple[float, ...]:
        """By kind of entry: whole word, each length of beginning."""
        got = self.cache.get((word, own))
        if got is None:
            if len(self.cache) >= C.HASH_TABLE:
                self.cache.clear()
            out = [0.0] * (1 + len(PREFIXES))
            for key in entries(word):
                if key in self.table:
                    out[0 if key[-1] == " " else PREFIXES.index(len(key)) + 1] = max(0.0, self.odds(*self.table[key], own))
            got = self.cache[word, own] = tuple(out) if any(out) else ()
        return got


def votes(text: bytes, lexicon: Lexicon, own: int = -1) -> tuple[list[float], list[float], list[float]]:
    """(votes of 0 or 1, further inputs of the classifier, votes of the groups of entries while training)."""
    ws = words(text)
    known = [(w, s) for w in ws if (s := lexicon.strength(w, own))]
    hits = [s for _, s in known]
    groups = np.zeros((1 + len(PREFIXES), GROUPS))
    for w, s in known if own >= 0 else ():
        for k, x in enumerate(s):
            if x >= TIERS[0]:
                groups[k, zlib.crc32(w.encode()) % GROUPS] = 1
    kinds = [sum(s[k] >= TIERS[0] for s in hits) for k in range(1 + len(PREFIXES))]
    best = [max(s) for s in hits]
    tiers = [sum(b >= t for b in best) for t in TIERS]
    n = len(ws)
    upper = sum(map(text.count, (b"!",)))
    caps = sum(w.isupper() and len(w) > 2 for w in text.split())
    address = sum(w in ADDRESS for w in ws)
    v = [float(c >= k) for c in (*kinds, *tiers) for k in (1, 2)]
    v += [float(upper > 0), float(10 * upper > n > 0), float(caps > 0), float(5 * caps > n > 0), float(address > 0)]
    top = sorted(best, reverse=True)[:3] + [0.0] * 3
    more = [np.log1p(c) for c in tiers] + [c / (n + 1) * 20 for c in tiers] + [x / 5 for x in top[:3]]
    return v, [float(x) for x in more], groups.reshape(-1).tolist()


def agreement(v: np.ndarray) -> np.ndarray:
    """0.95 for rows on the upper of two means of the share of voters that fire, 0.05 for the others."""
    share = v.mean(axis=1)
    lo, hi = share.min(), share.max()
    for _ in range(50):
        above = share > (lo + hi) / 2
        if above.all() or not above.any():
            break
        lo, hi = share[~above].mean(), share[above].mean()
    return np.where(above, 0.95, 0.05)


def label_model(v: np.ndarray, given: np.ndarray, rounds: int = 60, shrink: float = 0.05, ridge: float = 0.2) -> np.ndarray:
    """Posterior of class 1 for every row of votes.

    The votes have a mean per class and a shared covariance, shrunk to its diagonal and with a ridge (without it, voters
    that copy each other would become the class); ``given`` is one more voter,
    independent of them given the class, whose accuracy (0.01 to 0.99) is estimated like all else.
    """
    q = agreement(v)
    for _ in range(rounds):
        w1 = q.sum()
        w0 = len(q) - w1
        if min(w1, w0) < 1:  # the voters see one class only
            return np.where(given == 1, 0.95, 0.05)
        m1, m0 = (q @ v) / w1, ((1 - q) @ v) / w0
        d1, d0 = v - m1, v - m0
        cov = ((d1 * q[:, None]).T @ d1 + (d0 * (1 - q)[:, None]).T @ d0) / len(v)
        cov = (1 - shrink) * cov + np.diag(shrink * np.diag(cov) + ridge)
        weight = np.linalg.solve(cov, m1 - m0)
        hit = np.clip(q @ given / w1, 0.01, 0.99)  # how often the given label is 1 in either class
        false = np.clip((1 - q) @ given / w0, 0.01, 0.99)
        own = np.where(given == 1, np.log(hit / false), np.log((1 - hit) / (1 - false)))
        logit = (v - (m1 + m0) / 2) @ weight + own + np.log(w1 / w0)
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        moved, q = np.abs(new - q).max(), new
        if moved < 1e-4:
            break
    return q


class Classifier:
    def __init__(self, lexicon: Lexicon | None, x: np.ndarray | None = None, q: np.ndarray | None = None, ridge: float = 0.05):
        self.lexicon, self.weights = lexicon, None
        if x is None:
            return
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 0.05
        z = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])
        w, penalty = np.zeros(z.shape[1]), np.diag([*[ridge * len(x) / 100] * x.shape[1], 1e-6])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + penalty
            step = np.linalg.solve(h, z.T @ (q - p) - penalty @ w)
            w = w + step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.weights is None or not texts:
            return np.zeros(len(texts))
        x = np.array([sum(votes(t, self.lexicon)[:2], []) for t in texts])
        return 1 / (1 + np.exp(-np.clip(np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))]) @ self.weights, -700, 700)))


def fit(documents: DataFrame, labels: DataFrame, column: str = "toxic", sample: int = SAMPLE, size: int = LEXICON) -> Classifier:
    rows = C.cut(labelled(documents, labels, column, sample))  # at most `sample` rows; read twice

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = (Counter(), Counter())
        for b in batches:
            for t, y in zip(C.text_bytes(b.column(0)), b.column(1).to_pylist(), strict=True):
                n[y][""] += 1
                n[y].update({k for w in set(words(t)) for k in entries(w)})
            if sum(map(len, n)) > C.HASH_TABLE:
                yield flush(n)
        yield flush(n)

    def flush(n: tuple[Counter, Counter]) -> pa.RecordBatch:
        keys = [*(n[0].keys() | n[1].keys())]
        out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([n[y][k] for k in keys], pa.int64()) for y in (1, 0))], ["key", "pos", "neg"])
        n[0].clear()
        n[1].clear()
        return out

    counts = C.cut(C.arrow(rows, count, "key string, pos long, neg long").groupBy("key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    total = counts.where("key = ''").first()
    if total is None or not total.pos or not total.neg:
        return Classifier(None)
    n1, n0 = int(total.pos), int(total.neg)
    lift = F.log((F.col("pos") + 0.3) / (n1 + 1)) - F.log((F.col("neg") + 0.3 + 0.0005 * n0) / (n0 + 1))
    # rarer entries lose a document's own count while training, so two more than the least are asked for
    strong = counts.where("key <> '' and pos >= 3").withColumn("lift", lift).where(F.col("lift") > 1.0).orderBy(F.col("lift").desc(), "key").limit(size)
    lexicon = Lexicon({r.key: (r.pos, r.neg) for r in strong.collect()}, n1, n0)  # `size` entries at most

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column(1).to_pylist()
            out = [votes(t, lexicon, o) for t, o in zip(C.text_bytes(b.column(0)), y, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array([x[i] for x in out], pa.list_(pa.float64())) for i in (0, 1, 2))], ["y", "v", "x", "g"])

    got = C.arrow(rows, vote, "y int, v array<double>, x array<double>, g array<double>").toArrow()
    y = got.column("y").to_numpy()
    v = np.array(got.column("v").to_pylist(), dtype=float)
    x = np.column_stack([v, np.array(got.column("x").to_pylist(), dtype=float)])
    C.drop(rows, counts)
    return Classifier(lexicon, x, label_model(np.column_stack([v, np.array(got.column("g").to_pylist(), dtype=float)]), y))


def score(documents: DataFrame, model: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(C.text_bytes(b.column(1))), pa.float64())], ["doc_id", "score"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = C.arrow(docs, run, "doc_id long, score double")
    return out.select("doc_id", C.held_out("doc_id", FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(documents: DataFrame, model: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents``, all columns, whose score stays below the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.score(C.text_bytes(b.column(b.schema.get_field_index("text")))) < threshold, pa.bool_()))

    return C.arrow(documents, run, documents.schema)
