"""Quality rules: simple counts, and the divergence of a document's histograms from those of its language.

Two histograms of a document are compared with references of its language by the Jensen-Shannon distance (root of the
divergence in bits): shares of character classes, and shares of the language's common words with one bin for all others.
A reference is fitted to the corpus without labels: the common words are those that most documents of the language hold
(of ``REFERENCE`` words or more), and each bin's share is the median over these documents, so that neither a large group of
copies nor junk draws it away. Medians come from exact counts of shares in thousandths, summed by Spark; a language with
fewer than ``LEAST_DOCUMENTS`` such documents has no reference.

A document may lie as far away as its length explains: the limits are a constant and a part that falls with the root of
the number of words. Minimum lengths guard each test: ``WORDS`` words for any verdict, ``COMMON_WORDS`` for the one on
common words.

Defined cases: null text has no words and fails; null lang is a language of its own; a language without a reference is
judged by the counts alone; a bin that no reference document fills counts with the others; of words that equally many
documents hold, those first in byte order are common; rows that repeat an id, or null ids, are judged each; texts of any
length are read whole; columns but doc_id, text and lang are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WORDS, WINDOW, REPEATED = 20, 8, 30
REFERENCE, LEAST_DOCUMENTS, COMMON, COMMON_WORDS = 100, 20, 64, 50
#: (constant, part that is divided by the root of the number of words)
CLASS_LIMIT, WORD_LIMIT = (0.12, 1.1), (0.16, 1.8)

#: Counters of a task are sent on beyond this many entries.
HELD = 200_000
STRIPPED = b".,;:!?\"'()"
_CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:'\"?!-()")
N_CLASSES = len(_CLASSES) + 2
_CLASS = np.full(256, len(_CLASSES), dtype=np.uint8)  # other ASCII; then the rest, of which bytes that go on with a character are not counted
for _i, _s in enumerate(_CLASSES):
    _CLASS[np.frombuffer(_s, dtype=np.uint8)] = _i
_CLASS[128:] = N_CLASSES
_CLASS[192:] = N_CLASSES - 1
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", dtype=np.uint8)] = True


def classes(text: bytes) -> np.ndarray:
    """Code points by class."""
    return np.bincount(_CLASS[np.frombuffer(text, dtype=np.uint8)], minlength=N_CLASSES + 1)[:N_CLASSES]


def common_words(words: list[bytes]) -> Counter:
    return Counter(w.strip(STRIPPED) for w in map(bytes.lower, words))


def repeated_words(words: list[bytes], hashes: C.WordHashes) -> int:
    """Words that lie in a window that is found twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = hashes.of(words)
    acc = np.zeros(n, dtype=np.uint64)
    for i in range(WINDOW):
        acc = C.mix(acc * C._P + h[i : i + n])
    _, at, times = np.unique(acc, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(times[at] > 1)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two distributions."""
    m = (p + q) / 2
    part = lambda a: float(sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0))
    return max(0.0, (part(p) + part(q)) / 2) ** 0.5


def _documents(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string").alias("text"))


def _spilled(found: Iterator[Counter | None], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The sums of counters with tuple keys, in parts of at most about HELD entries."""
    held: Counter = Counter()

    def batch() -> pa.RecordBatch:
        keys = zip(*held.keys(), strict=True) if held else [[] for _ in schema.names[:-1]]
        return pa.RecordBatch.from_arrays([*(pa.array(list(k), f.type) for k, f in zip(keys, schema, strict=False)), pa.array(list(held.values()), pa.int64())], schema=schema)

    for c in found:
        held.update(c)
        if len(held) >= HELD:
            yield batch()
            held = Counter()
    yield batch()


def _vocabulary(docs: DataFrame) -> DataFrame:
    """(lang, words): the COMMON words that most reference documents of a language hold, the most common first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[Counter]:
            for b in batches:
                for lang, text in zip(b.column(0).to_pylist(), C.text_bytes(b.column(1)), strict=True):
                    ws = text.split()
                    if len(ws) >= REFERENCE:
                        yield Counter((lang, w) for w in common_words(ws))

        return _spilled(each(), pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())]))

    n = docs.select("lang", "text").mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    top = n.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("place") <= COMMON)
    return C.cut(top.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]).alias("words")))


def references(documents: DataFrame) -> DataFrame:
    """(lang, words, word_shares, class_shares) of every language with enough long documents: word_shares has one number
    more than words, for all other words."""
    docs = _documents(documents)
    words = _vocabulary(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[Counter]:
            known: dict[str, list[bytes]] = {}
            for b in batches:
                for i, (lang, text) in enumerate(zip(b.column(0).to_pylist(), C.text_bytes(b.column(1)), strict=True)):
                    ws = text.split()
                    if len(ws) < REFERENCE:
                        continue
                    if lang not in known:
                        known[lang] = b.column(2)[i].as_py()
                    c, n = classes(text), common_words(ws)
                    bins = (1000 * c // c.sum()).tolist() + [1000 * n[w] // len(ws) for w in known[lang]]
                    yield Counter((lang, f, x) for f, x in enumerate(bins) if x) + Counter([(lang, -1, 0)])

        return _spilled(each(), pa.schema([("lang", pa.string()), ("feature", pa.int32()), ("share", pa.int32()), ("n", pa.int64())]))

    seen = C.cut(docs.join(words, "lang").select("lang", "text", "words").mapInArrow(run, "lang string, feature int, share int, n long").groupBy("lang", "feature", "share").agg(F.sum("n").alias("n")))
    total = seen.where("feature = -1").where(F.col("n") >= LEAST_DOCUMENTS).select("lang", F.col("n").alias("all"))
    above = F.coalesce(F.sum("n").over(Window.partitionBy("lang", "feature").orderBy(F.desc("share")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the least share that half of the documents do not exceed; those without an entry have 0
    from_top = seen.where("feature >= 0").withColumn("above", above).join(total, "lang")
    median = from_top.where("2 * (all - above) >= all and 2 * (all - above - n) < all").select("lang", "feature", "share")
    shares = total.join(median, "lang", "left").groupBy("lang").agg(F.map_from_entries(F.collect_list(F.when(F.col("feature").isNotNull(), F.struct("feature", F.col("share").cast("double").alias("s"))))).alias("m"))
    share = lambda f: F.coalesce(F.try_element_at("m", f.cast("int")), F.lit(0.0))
    r = shares.join(words, "lang").withColumn("c", F.transform(F.sequence(F.lit(0), F.lit(N_CLASSES - 1)), share))
    r = r.withColumn("w", F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), share(i + N_CLASSES).alias("s"))), lambda x: x["s"] > 0))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    known = F.transform("w", lambda x: x["s"] / 1000)
    return r.where(add(F.col("c")) > 0).select("lang", F.col("w.word").alias("words"), F.concat(known, F.array(F.greatest(1 - add(known), F.lit(0.0)))).alias("word_shares"), F.transform("c", lambda x: x / add(F.col("c"))).alias("class_shares"))


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"


def judge(documents: DataFrame, refs: DataFrame, class_limit: tuple = CLASS_LIMIT, word_limit: tuple = WORD_LIMIT) -> DataFrame:
    """Counts, the verdict of the counts, the verdict of all tests, and the distances (null where a guard holds) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known = C.WordHashes(), {}
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
        for b in batches:
            rows = []
            for i, (lang, text) in enumerate(zip(b.column(1).to_pylist(), C.text_bytes(b.column(2)), strict=True)):
                if lang not in known:
                    words, ws, cs = (b.column(k)[i].as_py() for k in (3, 4, 5))
                    known[lang] = None if cs is None else (words, np.array(ws), np.array(cs))
                ref, words, c = known[lang], text.split(), classes(text)
                n, repeat = len(words), repeated_words(words, hashes)
                failed = n < WORDS or 100 * repeat > REPEATED * n
                dc = dw = None
                if ref and n >= WORDS:
                    dc = distance(c / c.sum(), ref[2])
                    if n >= COMMON_WORDS:
                        found = common_words(words)
                        h = np.array([found[w] for w in ref[0]] + [0], dtype=float)
                        h[-1] = n - h.sum()
                        dw = distance(h / n, ref[1])
                limit = lambda v: v[0] + v[1] / max(n, 1) ** 0.5  # noqa: B023, E731
                kept = not failed and (dc is None or dc <= limit(class_limit)) and (dw is None or dw <= limit(word_limit))
                rows.append((n, int(c.sum() - c[3]), int(_SYMBOL[np.frombuffer(text, dtype=np.uint8)].sum()), duplicate_lines(text), repeat, failed, kept, dc, dw))
            columns = zip(*rows, strict=True) if rows else [[] for _ in names[1:]]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(v), kinds[k.split()[1]]) for v, k in zip(columns, SCHEMA.split(", ")[1:], strict=True))], names)

    refs = C.cut(refs)  # few rows: Spark sees their size and decides how to join
    docs = _documents(documents).join(refs, "lang", "left").select("doc_id", "lang", "text", "words", "word_shares", "class_shares")
    return docs.mapInArrow(run, SCHEMA)
