"""Language-model scores from a hidden Markov model trained by Baum-Welch counts that are summed across partitions.

Tokens are the A-Z lower-cased words and one end per text. Word counts of all training texts form a table that stays
distributed. The ``HEAD`` most frequent words (of at most ``WORD_BYTES`` bytes; a fixed bound) go to the workers; all
other words of a text meet their counts in a join, so counts are exact at any vocabulary size.

The model's symbols are the end, the ``SYMBOLS`` most frequent words, and ``CLASSES`` classes of the remaining words (by
their first bytes); a word of a class has probability (c + 1) / (N + V + 1) of its class's counts, one unseen word's mass
included. Baum-Welch starts from a fit to the counts of neighbouring symbols in all training texts (the second of a
pair by groups, so the table has a fixed size); its ``PASSES`` passes then count expected transitions and emissions over all training texts, summed by symbol across partitions. Scores are exact
likelihoods by the scaled forward recursion, vectorised over texts of similar length; a text of any length is scored
and trained on whole: for texts over ``SEGMENT`` tokens the backward pass keeps the forward state at the start of each
segment and recomputes the rest of it, which bounds the memory and gives the same counts.

Defined cases: null text is empty (its end is its only token); a null doc_id is in training; rows that repeat an id
are scored each; without training tokens every word scores as in an empty table (base 0 each); an empty table gives no
rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

HEAD, WORD_BYTES = 200_000, 64
SYMBOLS, CLASSES, STATES = 4096, 512, 8
START_ROUNDS, PASSES, SEGMENT = 100, 2, 8192
#: Groups of the second symbol of a pair: so many frequent symbols by themselves, and groups that the others share.
OWN, SHARED = 128, 32
#: Tokens that a worker holds at once.
HELD = 250_000
FOLDS, FOLD = 7, 2


def word_class(w: bytes) -> int:
    return zlib.crc32(w[:3]) % CLASSES


class Tables:
    """What each worker needs to turn words into symbols; its size does not depend on the corpus."""

    def __init__(self, words: list[bytes], counts: list[int], ends: int, total: int, distinct: int, class_n: np.ndarray, class_v: np.ndarray):
        self.head = {w: i for i, w in enumerate(words)}
        self.count = np.array([*counts, ends], dtype=np.int64)  # the end comes last
        classes = np.array([word_class(w) for w in words], dtype=np.int64)
        top = min(SYMBOLS, len(words))
        self.symbol = np.r_[np.arange(1, top + 1), 1 + SYMBOLS + classes[top:], 0].astype(np.int32)
        self.total, self.distinct = total, distinct
        self.norm = np.log10(total + distinct + 1)
        with np.errstate(divide="ignore"):
            self.class_norm = np.log10(class_n + class_v + 1)
            self.log_count = np.log10(self.count + 1)
        # log10 of a word within its class; top words and the end are their own symbols
        self.within = np.r_[np.zeros(top), self.log_count[top:-1] - self.class_norm[classes[top:]], 0.0]

    def codes(self, text: bytes) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """Indices into the tables (-1: not in the head), the end included; the words not in the head and their classes."""
        ws = C.words_of(text)
        c = np.fromiter(map(self.head.get, ws, repeat(-1)), dtype=np.int64, count=len(ws))
        rest = [ws[i] for i in np.flatnonzero(c < 0)]
        classes = np.fromiter(map(word_class, rest), dtype=np.int64, count=len(rest))
        return np.append(c, len(self.head)), rest, classes

    def symbols(self, codes: np.ndarray, classes: np.ndarray) -> np.ndarray:
        s = self.symbol[codes]
        s[codes < 0] = 1 + SYMBOLS + classes
        return s


class Model:
    """A hidden Markov model over ``1 + SYMBOLS + CLASSES`` symbols."""

    def __init__(self, start: np.ndarray, trans: np.ndarray, emit: np.ndarray):
        self.start, self.trans, self.emit = start, trans, emit  # emit: [symbol, state]

    @classmethod
    def from_counts(cls, start: np.ndarray, trans: np.ndarray, emit: np.ndarray) -> Model:
        share = (emit.sum(axis=1) + 0.05) / (emit + 0.05 / len(emit[0])).sum()
        share /= share.sum()
        mass = 0.002 * emit.sum(axis=0) + 1.0  # a little of each state goes to the corpus-wide shares
        e = emit + mass * share[:, None]
        t = trans + 0.1
        return cls((start + 0.1) / (start + 0.1).sum(), t / t.sum(axis=1, keepdims=True), e / e.sum(axis=0))

    def forward(self, seqs: list[np.ndarray], back: bool = False):
        """log10 likelihoods; with ``back`` also expected counts (start, trans, emit). Longest sequences first inside."""
        order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
        n = np.array([len(seqs[i]) for i in order])
        T = int(n[0])
        live = np.searchsorted(-n, -np.arange(1, T + 1), side="right")  # sequences that have a token at each step
        first = np.r_[0, np.cumsum(live)]
        flat = np.empty(first[-1], dtype=np.int32)
        for rank, i in enumerate(order):
            flat[first[: n[rank]] + rank] = seqs[i]
        ll = np.zeros(len(seqs))
        a = np.empty((first[-1] if back else len(seqs), STATES))
        scale = np.empty(first[-1])
        cur = None
        for t in range(T):
            k = live[t]
            e = self.emit[flat[first[t] : first[t + 1]]]
            cur = (self.start * e) if t == 0 else (cur[:k] @ self.trans) * e
            s = cur.sum(axis=1)
            cur = cur / s[:, None]
            scale[first[t] : first[t + 1]] = s
            if back:
                a[first[t] : first[t + 1]] = cur
        logs = np.log10(scale)
        for t in range(T):
            ll[: live[t]] += logs[first[t] : first[t + 1]]
        out = np.empty(len(seqs))
        out[order] = ll
        if not back:
            return out
        trans = np.zeros((STATES, STATES))
        emit = np.zeros_like(self.emit)
        post = np.empty_like(a)
        beta = np.ones((live[-1], STATES))
        for t in range(T - 1, -1, -1):
            k = live[t]
            if len(beta) < k:
                beta = np.vstack([beta, np.ones((k - len(beta), STATES))])
            at = slice(first[t], first[t + 1])
            post[at] = a[at] * beta
            if t:
                w = self.emit[flat[at]] * beta / scale[at, None]
                trans += self.trans * (a[first[t - 1] : first[t - 1] + k].T @ w)
                beta = w @ self.trans.T
        for i in range(STATES):
            emit[:, i] = np.bincount(flat, weights=post[:, i], minlength=len(emit))
        return out, post[: live[0]].sum(axis=0), trans, emit


    def long_counts(self, s: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts (start, trans, emit) of one sequence of any length, in memory of a segment."""

        def forward(part: np.ndarray, cur: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
            a, scale = np.empty((len(part), STATES)), np.empty(len(part))
            for t, e in enumerate(self.emit[part]):
                cur = (self.start if cur is None else cur @ self.trans) * e
                scale[t] = cur.sum()
                a[t] = cur = cur / scale[t]
            return a, scale

        before: list[np.ndarray | None] = [None]
        for i in range(0, len(s), segment):
            before.append(forward(s[i : i + segment], before[-1])[0][-1])
        trans, emit, beta = np.zeros((STATES, STATES)), np.zeros_like(self.emit), np.ones(STATES)
        for k in range(len(before) - 2, -1, -1):
            part = s[k * segment : (k + 1) * segment]
            a, scale = forward(part, before[k])
            post = np.empty_like(a)
            for t in range(len(part) - 1, -1, -1):
                post[t] = a[t] * beta
                last = a[t - 1] if t else before[k]
                if last is not None:
                    w = self.emit[part[t]] * beta / scale[t]
                    trans += self.trans * np.outer(last, w)
                    beta = self.trans @ w
            for i in range(STATES):
                emit[:, i] += np.bincount(part, weights=post[:, i], minlength=len(emit))
        return post[0], trans, emit


def _groups(items: Iterator[tuple], n=lambda x: len(x)) -> Iterator[list]:
    """Items in groups of about HELD tokens; each group has texts of similar length.

    The recursions take a step per token of the longest text in a group, whatever the others' lengths.
    """
    groups: dict[int, list] = {}
    sizes: dict[int, int] = {}
    for x in items:
        k = max(0, n(x).bit_length() - 7) // 2
        groups.setdefault(k, []).append(x)
        sizes[k] = sizes.get(k, 0) + n(x)
        if sizes[k] >= HELD:
            yield groups.pop(k)
            sizes[k] = 0
    yield from groups.values()


def _sequences(column: pa.Array) -> Iterator[np.ndarray]:
    """The rows of an Arrow list column without nulls, without a copy."""
    values, at = column.values.to_numpy(), column.offsets.to_numpy()
    return (values[i:j] for i, j in zip(at[:-1], at[1:]))


def _expected(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, trans, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros_like(model.emit)
        for group in _groups(s for b in batches for s in _sequences(b.column(0))):
            short = [s for s in group if len(s) <= SEGMENT]
            parts = [model.forward(short, back=True)[1:]] if short else []
            parts += [model.long_counts(s) for s in group if len(s) > SEGMENT]
            for a, b, c in parts:
                start += a
                trans += b
                emit += c
        rows = np.vstack([start, trans, emit])
        some = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *(pa.array(rows[some, i]) for i in range(STATES))], ["i", *(f"e{i}" for i in range(STATES))])

    return run


def _word_counts(train: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array([*n.keys()], pa.binary()), pa.array([*n.values()], pa.int64())], ["w", "c"])
        for b in batches:
            for t in C.text_bytes(b.column(0)):
                n.update(C.words_of(t))
                if len(n) > 4 * C.WORD_TABLE // 2:
                    yield out()
                    n.clear()
        yield out()

    return train.mapInArrow(run, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))


def count(train: DataFrame) -> tuple[Tables, DataFrame]:
    """Tables of the head and the distributed word counts of ``train`` (text)."""
    counts = C.cut(_word_counts(train.select("text")))
    top = counts.where(F.length("w") <= WORD_BYTES).orderBy(F.col("c").desc(), "w").limit(HEAD).toArrow()  # HEAD rows at most
    words, freq = top.column("w").to_pylist(), top.column("c").to_pylist()
    del top
    ends = train.count()
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # totals by class of the words that are no symbols of their own
    cls = (F.crc32(F.substring("w", 1, 3)) % CLASSES).alias("k")
    n, v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.groupBy(cls).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():  # CLASSES rows at most
        n[r.k], v[r.k] = r.n, r.v
    for w, c in zip(words[:SYMBOLS], freq[:SYMBOLS]):
        n[word_class(w)] -= c
        v[word_class(w)] -= 1
    return Tables(words, freq, ends, int(total.n) + ends, total.v + (ends > 0), n, v), counts


def code(docs: DataFrame, tables) -> DataFrame:
    """Each text once: its symbols, what the head tables say of it, and its words outside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables.value
        for b in batches:
            cols: list[list] = [[] for _ in range(8)]
            for text in C.text_bytes(b.column(0)):
                codes, rest, classes = t.codes(text)
                known = codes[codes >= 0]
                base = float(t.log_count[known].sum() - len(codes) * t.norm)
                inner = float(t.within[known].sum() - t.class_norm[classes].sum())
                tail = Counter(rest)
                row = (xxhash.xxh3_64_intdigest(text) - (1 << 63), len(codes), int((t.count[known] > 0).sum()), base, inner, [*tail.keys()], [*tail.values()], t.symbols(codes, classes).astype(np.int16))
                for col, v in zip(cols, row, strict=True):
                    col.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int16())]
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "h", "n_tokens", "n_known", "base", "inner", "words", "times", "symbols"])

    return C.cut(docs.select("text", "doc_id").mapInArrow(run, "doc_id long, h long, n_tokens long, n_known long, base double, inner double, words array<binary>, times array<long>, symbols array<short>"))


def _group(symbols: np.ndarray) -> np.ndarray:
    """Groups of symbols: the most frequent ones by themselves, the others dealt to SHARED groups."""
    return np.where(symbols < OWN, symbols, OWN + symbols % SHARED)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, n): how often a symbol stands before one of a group; a text's first symbol follows its end."""
    groups = _group(np.arange(1 + SYMBOLS + CLASSES))
    n = np.zeros(len(groups) * (OWN + SHARED), dtype=np.int64)
    for b in batches:
        for s in _sequences(b.column(0)):
            for i in range(0, len(s), HELD):
                part = s[i : i + HELD].astype(np.int64)
                after = np.append(s[i + 1 : i + len(part)], s[(i + len(part)) % len(s)])
                np.add.at(n, part * (OWN + SHARED) + groups[after], 1)
    cell = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(n[cell])], ["cell", "n"])


def start(coded: DataFrame) -> Model:
    """The model from which the passes start, fitted to the pairs of neighbours in all of ``coded`` (symbols).

    The counts of pairs are a table of fixed size; a round of expectation and maximisation on it is a few products of matrices.
    """
    got = coded.select("symbols").mapInArrow(_pairs, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # symbols times groups at most
    groups = _group(np.arange(1 + SYMBOLS + CLASSES))
    n = np.zeros(len(groups) * (OWN + SHARED))
    n[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    n = n.reshape(len(groups), -1)
    # states differ at first by a deterministic random tilt of the shares
    rng = np.random.Generator(np.random.PCG64(11))
    emit = (n.sum(axis=1) + 0.01)[:, None] * rng.gamma(2.0, 0.5, (len(n), STATES))
    model = Model.from_counts(np.ones(STATES), np.eye(STATES) * 50 + 1.0, emit)
    for _ in range(START_ROUNDS if n.any() else 0):
        grouped = np.zeros((n.shape[1], STATES))
        np.add.at(grouped, groups, model.emit)
        joint = (emit.sum(axis=0) / emit.sum())[:, None] * model.trans
        seen = n / ((model.emit @ joint) @ grouped.T)
        second = seen @ grouped
        trans = joint * (model.emit.T @ second)
        emit = model.emit * (second @ joint.T)
        model = Model.from_counts((emit[0] / max(emit[0].sum(), 1e-300)) @ trans, trans, emit)
    return model


def baum_welch(coded: DataFrame) -> Model:
    """A model of the texts in ``coded`` (symbols): a start from their pairs of neighbours, then PASSES passes, all over all texts."""
    model = start(coded)
    for _ in range(PASSES):
        sums = coded.select("symbols").mapInArrow(_expected(model), "i long, " + ", ".join(f"e{i} double" for i in range(STATES)))
        got = sums.groupBy("i").agg(*[F.sum(f"e{i}").alias(f"e{i}") for i in range(STATES)]).toArrow()  # one row per symbol or state
        rows = np.zeros((1 + STATES + 1 + SYMBOLS + CLASSES, STATES))
        rows[got.column("i").to_numpy()] = np.column_stack([got.column(f"e{i}").to_numpy() for i in range(STATES)])
        if rows.any():
            model = Model.from_counts(rows[0], rows[1 : 1 + STATES], rows[1 + STATES :])
    return model


def score(documents: DataFrame, folds: int = FOLDS, fold: int = FOLD) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    train = docs.where(~C.held_out("doc_id", folds, fold))
    local, counts = count(train)
    tables = spark.sparkContext.broadcast(local)
    coded = code(docs, tables)
    shared = spark.sparkContext.broadcast(baum_welch(coded.where(~C.held_out("doc_id", folds, fold)).select("symbols")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value

        def rows():
            for b in batches:
                yield from zip(_sequences(b.column(0)), zip(*(c.to_pylist() for c in b.columns[1:])))

        for group in _groups(rows(), lambda x: len(x[0])):
            ll = m.forward([s for s, _ in group])
            doc, h, n, known, base, inner = zip(*(r for _, r in group))
            cols = [pa.array(doc, pa.int64()), pa.array(h, pa.int64()), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(ll + np.array(inner))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "h", "n_tokens", "n_known", "base", "score"])

    head = coded.select("symbols", "doc_id", "h", "n_tokens", "n_known", "base", "inner").mapInArrow(run, "doc_id long, h long, n_tokens long, n_known long, base double, score double")
    tail = coded.select("doc_id", "h", F.explode(F.arrays_zip("words", "times")).alias("x")).select("doc_id", "h", F.col("x.words").alias("w"), F.col("x.times").alias("n"))
    tail = tail.join(counts, "w").groupBy("doc_id", "h").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("s"), F.sum("n").alias("k"))
    # rows that repeat an id and its text share a key: each takes an equal part of what they gathered together
    times = coded.groupBy("doc_id", "h").agg(F.count("*").alias("m")).where("m > 1")
    for more, p in ((tail, "t"), (times, "m")):
        more = more.withColumnsRenamed({"doc_id": f"{p}_id", "h": f"{p}_h"})
        head = head.join(more, F.col("doc_id").eqNullSafe(F.col(f"{p}_id")) & (F.col("h") == F.col(f"{p}_h")), "left")
    part = F.coalesce(F.col("m"), F.lit(1))
    gathered = F.coalesce(F.col("s"), F.lit(0.0)) / part
    return head.select(
        "doc_id", C.held_out("doc_id", folds, fold).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce(F.col("k") / part, F.lit(0)).cast("long")).alias("n_known"),
        F.lit(local.total).cast("long").alias("train_tokens"), (F.col("base") + gathered).alias("base_score"), (F.col("score") + gathered).alias("score"),
    )
