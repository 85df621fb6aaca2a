"""Substring dedup by paragraph MinHash: colliding paragraphs are joined, verified and clustered; repeats are removed.

Paragraphs are lines of at least ``LINE`` words, cut inside after sentence ends, and shorter lines gathered up to a line
start; where text has no sentence end nearby, any word may be a cut. Of these places, those are taken whose hash of the
two words around is the least nearby, so that only the words around a cut decide it. Gathered lines under ``GATHERED``
words (licence lines, headings) and pieces under ``LEAST`` words are no paragraphs. Equal paragraphs fold into one node; the nodes'
5-word shingles go through one-permutation MinHash with ``BANDS`` bands of ``ROWS`` bins (at a likeness of 0.8 a pair
meets with probability 0.998). All pairs that share a bucket are decided as in ``minhash``: stars around the member
that shares most buckets, then an exact join across the components; pairs are verified by the exact Jaccard likeness
of their shingle sets, and links are clustered by connected components. Of each cluster the first occurrence (doc_id,
then place) stays, all others are removed from the texts. Of a paragraph that is alike, not equal, to the first, words
before and after all that the two share stay where they are more than SHINGLE: they belong to what surrounds the passage.

Passages that paragraphs cut differently are found by grams: the word stream, whatever its lines and sentences, is cut
where a hash of two words is least within ``NEAR`` words on either side, and the fewest pieces from a cut on that hold
``RUN`` words make a gram. Of equal grams clear of removed paragraphs the first stays and the others are removed.

Defined cases: null or blank text has no paragraphs and is returned as it is; a row with a null doc_id is returned as
it is; rows that repeat a doc_id are one document (what stands at the same place stays in each); ties are broken by
doc_id, then by place; texts of any length are taken whole; all columns are kept, whatever their names (with a report,
those of its names are replaced); an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .minhash import clusters, tours, widen

LINE, GATHERED, LEAST, FAR = 24, 20, 10, 48
NEAR, RUN = 4, 20
#: Words away from sentence ends are cuts only under this hash: the least of 2 * LINE words nearly always is.
RARE = np.uint64(1 << 61)
ROWS, BANDS, SHINGLE = 2, 6, 5
PERCENT = 80
STARS = (1,)
REPORT = ("n_removed", "removed_words", "removed_spans", "first_docs")
_WORD = re.compile(rb"[^ \t-\r]+")
_BLANK, _STOP = (np.isin(np.arange(256), [*x]) for x in (b" \t\n\x0b\x0c\r", b".!?"))


def minima(at: np.ndarray, value: np.ndarray, reach: int) -> np.ndarray:
    """Which of the sorted places ``at`` have the least value within ``reach`` words on either side; the first of equals."""
    least = np.ones(len(at), dtype=bool)
    for s in range(1, len(at)):
        near = at[s:] - at[:-s] <= reach
        if not near.any():
            break
        least[s:] &= ~near | (value[s:] < value[:-s])
        least[:-s] &= ~near | (value[:-s] <= value[s:])
    return least


@dataclass(frozen=True)
class Words:
    """Texts laid end to end: the hashes of their words, and where each text begins (one more place: the end)."""

    h: np.ndarray
    begin: np.ndarray

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, at, side="right") - 1


def units(texts: list[bytes], table: C.WordHashes) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of the texts, and their paragraphs as ranges of words; no text has a say in another's."""
    low = [t.lower() for t in texts]
    words = [t.split() for t in low]
    begin = np.concatenate(([0], np.cumsum([len(w) for w in words], dtype=np.int64)))
    h, n = table.of([*chain.from_iterable(words)]), int(begin[-1])
    out = Words(h, begin)
    if not n:
        return out, begin[:0], begin[:0]
    raw = np.frombuffer(b"\n".join(low) + b" ", dtype=np.uint8)
    blank = _BLANK[raw]
    last = np.flatnonzero(blank[1:] & ~blank[:-1])  # the last byte of each word
    line = np.searchsorted(np.flatnonzero(raw == 10), last)
    start = np.concatenate(([0], np.flatnonzero(line[1:] != line[:-1]) + 1))
    size = np.diff(start, append=n)
    long = size >= LINE
    value = np.full(n, np.iinfo(np.uint64).max)  # of a cut before each word
    value[1:] = C.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    heads = begin[:-1][begin[1:] > begin[:-1]]
    value[heads] = np.iinfo(np.uint64).max
    # lines, and stretches of short lines, lie further apart than any reach: none decides a cut in another
    new = np.zeros(n + 1, dtype=bool)
    new[heads] = True
    apart = np.cumsum(long | np.concatenate(([True], long[:-1])) | new[start]) * 1000
    line_of = np.repeat(np.arange(len(size)), size)
    inside = np.repeat(long, size)
    shift = np.arange(n) + apart[line_of]
    first = start[~long]
    cuts = [heads, start[long], (start + size)[long], np.array([n]), first[minima(shift[first], value[first], GATHERED - 1)]]
    after = shift - (start + apart)[line_of]
    room = inside & (after >= LEAST) & (size[line_of] - after >= LEAST)
    stop = np.zeros(n, dtype=bool)
    stop[1:] = _STOP[raw[last[:-1]]]
    ends = np.flatnonzero(stop & room)
    cuts.append(ends[minima(shift[ends], value[ends], LEAST - 1)])
    # words without a sentence end, or an end of the line, within FAR words
    far = np.flatnonzero(inside & (after > FAR) & (size[line_of] - after > FAR) & (value < RARE))
    at = np.searchsorted(shift[ends], shift[far])
    there = np.concatenate(([-(1 << 60)], shift[ends], [1 << 60]))
    far = far[np.minimum(shift[far] - there[at], there[at + 1] - shift[far]) > FAR]
    cuts.append(far[minima(shift[far], value[far], LINE)])
    at = np.unique(np.concatenate(cuts))
    a, b = at[:-1], at[1:]
    keep = b - a >= np.where(inside[a], LEAST, GATHERED)
    return out, a[keep], b[keep]


def grams(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end, key) of every gram; a cut depends on the NEAR + 1 words before and after it only."""
    h, n = w.h, len(w.h)
    if n < RUN:
        return w.begin[:0], w.begin[:0], w.begin[:0]
    first = np.zeros(n, dtype=bool)
    first[w.begin[:-1][w.begin[1:] > w.begin[:-1]]] = True
    pad = NEAR + 2  # between texts
    place = np.arange(n) + np.repeat(np.arange(len(w.begin) - 1) * pad, np.diff(w.begin))
    v = np.full(place[-1] + 1, np.iinfo(np.uint64).max)
    v[place[1:]] = C.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])  # decides the cut before a word
    v[place[first]] = np.iinfo(np.uint64).max
    least = np.ones(len(v), dtype=bool)
    for i in range(1, NEAR + 1):
        least[i:] &= v[i:] < v[:-i]
        least[:-i] &= v[:-i] <= v[i:]
    at = np.append(np.flatnonzero((least[place] & ~first) | first), n)
    i = np.minimum(np.searchsorted(at, at + RUN), len(at) - 1)
    ok = (at[i] - at >= RUN) & (at[i] <= w.begin[np.minimum(w.text_of(at) + 1, len(w.begin) - 1)])
    a, b = at[ok], at[i[ok]]
    # words weighted by powers of an odd number: the key of a range is a difference of sums, divided by its start's power
    odd = 0x9E3779B97F4A7C15
    up, down = (np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(n, np.uint64(x))))) for x in (odd, pow(odd, -1, 1 << 64)))
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(C.mix(h) * up[:-1])))
    k = C.mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
    return a, b, (k >> np.uint64(1)).view(np.int64)


def _chunks(texts: list[bytes], most: int = 1 << 19) -> Iterator[list[bytes]]:
    """Neighbouring texts of about ``most`` bytes together; a longer text alone."""
    held, n = [], 0
    for t in texts:
        if held and n + len(t) > most:
            yield held
            held, n = [], 0
        held.append(t)
        n += len(t)
    if held:
        yield held


def keys(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    raw, digest = memoryview(np.ascontiguousarray(h)).cast("B"), xxhash.xxh3_64_intdigest
    return np.array([digest(raw[8 * x : 8 * y]) & 0x7FFFFFFFFFFFFFFF for x, y in zip(a.tolist(), b.tolist(), strict=True)], dtype=np.int64)


def _shingle_hashes(h: np.ndarray) -> np.ndarray:
    acc = np.full(max(0, len(h) - SHINGLE + 1), np.uint64(SHINGLE), dtype=np.uint64)
    for i in range(SHINGLE if len(acc) else 0):
        acc = C.mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - SHINGLE + 1 + i])
    return acc


def bands(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Band keys [paragraph, BANDS], for all paragraphs at once."""
    s, bins = _shingle_hashes(h), ROWS * BANDS
    sig = np.full(len(a) * bins, np.iinfo(np.uint64).max, dtype=np.uint64)
    size, first = b - a - SHINGLE + 1, a
    who = np.repeat(np.arange(len(a)), size)
    at = np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
    v = s[at]
    np.minimum.at(sig, who * bins + (((v >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64), v)
    sig = sig.reshape(-1, bins)
    full = sig != np.iinfo(np.uint64).max
    tour, original, have = tours(bins), sig.copy(), full.copy()
    for k in range(bins):
        if full.all():
            break
        take = ~full & have[:, tour[:, k]]
        sig = np.where(take, original[:, tour[:, k]], sig)
        full |= take
    acc = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(a), BANDS)).copy()
    v = sig.reshape(len(a), BANDS, ROWS)
    for i in range(ROWS):
        acc = C.mix(acc * np.uint64(0x9E3779B97F4A7C15) + v[:, :, i])
    return acc.view(np.int64)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paragraphs with their bands, grams with none; places are counted in the words of the text."""
    table = C.WordHashes()
    for b in batches:
        done = 0
        for texts in _chunks(C.text_bytes(b.column(1))):
            w, a, e = units(texts, table)
            ga, ge, gk = grams(w)
            at, to, k = np.concatenate((a, ga)), np.concatenate((e, ge)), np.concatenate((keys(w.h, a, e), gk))
            text = w.text_of(at)
            some = bands(w.h, a, e).reshape(-1) if len(a) else np.empty(0, dtype=np.int64)
            offsets = np.minimum(np.arange(len(at) + 1), len(a)) * BANDS
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(some))
            cols = [b.column(0).take(pa.array(done + text)), pa.array((at - w.begin[text]).astype(np.int32)), pa.array((to - w.begin[text]).astype(np.int32)), pa.array(k), lists]
            done += len(texts)
            whole = pa.RecordBatch.from_arrays(cols, ["doc_id", "at", "to", "k", "bands"])
            yield from (whole.slice(i, 20_000) for i in range(0, max(1, len(at)), 20_000))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, k): those whose bucket has another member. The last row is held until the next is seen."""
    h = k = np.empty(0, dtype=np.int64)
    met = False  # the held row's bucket has had another member
    for b in batches:
        if not b.num_rows:
            continue
        h, k = np.r_[h, b.column(0).to_numpy()], np.r_[k, b.column(1).to_numpy()]
        same = h[1:] == h[:-1]
        keep = np.r_[met, same[:-1]] | same if len(h) > 1 else np.empty(0, dtype=bool)
        yield pa.RecordBatch.from_arrays([pa.array(h[:-1][keep]), pa.array(k[:-1][keep])], ["h", "k"])
        met = bool(same[-1]) if len(h) > 1 else False
        h, k = h[-1:], k[-1:]
    if met:
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(k)], ["h", "k"])


def _sets(docs_bits, key_bits):
    """(k, s): shingle sets of the paragraphs that the sieve of keys lets through, in texts that the other lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = C.WordHashes()
        for b in batches:
            b = b.filter(pa.array(C.Sieve.passes(docs_bits.value, b.column(1).to_numpy(), b.column(2).to_numpy()), pa.bool_()))
            key, sets = [], []
            for texts in _chunks(C.text_bytes(b.column(0))):
                w, x, y = units(texts, table)
                ks = keys(w.h, x, y)
                want = np.flatnonzero(C.Sieve.holds(key_bits.value, ks))
                s = _shingle_hashes(w.h)
                for i in want.tolist():
                    one = np.sort(s[x[i] : y[i] - SHINGLE + 1])
                    key.append(ks[i])
                    sets.append(one[np.concatenate(([True], one[1:] != one[:-1]))].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(sets, pa.binary())], ["k", "s"])

    return run


def repeats(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, at, k, head_doc, head_at, ref): every paragraph and gram that repeats the first one of its cluster.

    ref: the shingle set of that first one, where it is not equal.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    both = C.cut(C.arrow(docs, _units, "doc_id long, at int, to int, k long, bands array<long>"))
    rows, runs = both.where("size(bands) > 0"), C.cut(both.where("size(bands) = 0").drop("bands"))
    nodes = C.cut(rows.groupBy("k").agg(F.min(F.struct("doc_id", "at")).alias("head"), F.count("*").alias("c"), F.first("bands").alias("bands")))
    places = C.cut(rows.select("doc_id", "at", "to", "k"))
    C.drop(both)
    stream = nodes.select(F.explode("bands").alias("h"), "k").repartition("h").sortWithinPartitions("h", "k")
    members = C.cut(C.arrow(stream, _shared, "h long, k long"))
    small = C.cut(nodes.select("k", "head", "c"))
    C.drop(nodes)
    C.release(documents.sparkSession)
    wanted = C.cut(members.select("k").distinct().join(small.select("k", "head.doc_id"), "k"))
    sieve, named = C.Sieve(wanted, "doc_id"), C.Sieve(wanted, "k", local=True)
    sets = C.arrow(docs.select("text", *C.Sieve.places("doc_id")), _sets(sieve.bits, named.bits), "k long, s binary")
    sets = C.cut(sets.join(wanted.select("k"), "k", "left_semi").groupBy("k").agg(F.first("s").alias("s")))
    sizes = sets.select("k", (F.octet_length("s") / 8).cast("long").alias("n"))
    wide = widen(members.join(members.groupBy("h").agg(F.count("*").alias("c")), "h"), sizes)
    C.drop(members)
    comp = clusters(wide, sets, percent, STARS)
    C.drop(wanted, wide)
    C.release(documents.sparkSession)
    # only nodes that occur twice or are linked have anything to remove
    linked = comp.withColumnRenamed("node", "k") if comp is not None else small.where("false").select("k", F.col("k").alias("label"))
    some = small.join(linked, "k", "left").where("c > 1 or label is not null").select("k", "head", F.coalesce("label", "k").alias("label"))
    some = C.cut(some)
    heads = C.cut(some.groupBy("label").agg(F.min(F.struct("head", "k")).alias("first")))
    both = some.select("k", "label").join(heads, "label").select("k", F.col("first.head").alias("head"), F.col("first.k").alias("head_k"))
    refs = both.where("k <> head_k").join(sets.select(F.col("k").alias("head_k"), F.col("s").alias("ref")), "head_k").select("k", "head", "ref")
    some = C.cut(both.where("k = head_k").select("k", "head", F.lit(None).cast("binary").alias("ref")).union(refs))
    C.drop(sets, small, heads)
    out = C.cut(places.join(some, "k").where("doc_id <> head.doc_id or at <> head.at"))
    C.drop(places)
    # grams that occur more than once, clear of the paragraphs removed
    often = runs.groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select("k")
    met = C.cut(runs.join(often, "k", "left_semi"))
    C.drop(runs)
    gone = out.select(F.col("doc_id").alias("d"), F.col("at").alias("x"), F.col("to").alias("y"))
    clear = C.cut(met.join(gone, (F.col("doc_id") == F.col("d")) & (F.col("at") < F.col("y")) & (F.col("x") < F.col("to")), "left_anti"))
    C.drop(met)
    heads = clear.groupBy("k").agg(F.min(F.struct("doc_id", "at")).alias("head"))
    again = clear.join(heads, "k").where("doc_id <> head.doc_id or at <> head.at")
    out = out.select("doc_id", "at", "k", "head", "ref").union(again.select("doc_id", "at", "k", "head", F.lit(None).cast("binary")))
    return out.select("doc_id", "at", "k", F.col("head.doc_id").alias("head_doc"), F.col("head.at").alias("head_at"), "ref")


def strip(text: bytes, gone: dict[tuple[int, int], bytes | None], table: C.WordHashes) -> tuple[bytes, list[tuple[int, int]], int]:
    """Text without the paragraphs and grams ``gone`` ((first word, key): ref), the byte spans cut, and how many words they had."""
    w, a, b = units([text], table)
    found = []
    for x, y, k in zip(a.tolist(), b.tolist(), keys(w.h, a, b).tolist(), strict=True):
        if (x, k) in gone:
            ref = gone[x, k]
            if ref:
                own = _shingle_hashes(w.h[x:y])
                met = np.flatnonzero(np.isin(own, np.frombuffer(ref, dtype=np.uint64)))
                if 2 * len(met) >= len(own):  # else they are linked by others only
                    before, after = int(met[0]), y - x - int(met[-1]) - SHINGLE
                    x, y = x + before * (before > SHINGLE), y - after * (after > SHINGLE)
            found.append((x, y))
    found += [(x, y) for x, y, k in zip(*(c.tolist() for c in grams(w)), strict=True) if (x, k) in gone]
    drop_: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if drop_ and a < drop_[-1][1]:
            drop_[-1] = (drop_[-1][0], max(b, drop_[-1][1]))
        else:
            drop_.append((a, b))
    if not drop_:
        return text, [], 0
    spans = [m.span() for m in _WORD.finditer(text)]
    out, last, cut = [], 0, []
    for a, b in drop_:
        s = spans[a][0]
        e = spans[b][0] if b < len(spans) else len(text)
        out.append(text[last:s])
        cut.append((s, e))
        last = e
    out.append(text[last:])
    return b"".join(out).rstrip() if last == len(text) else b"".join(out), cut, sum(b - a for a, b in drop_)


def dedup(documents: DataFrame, percent: int = PERCENT, report: bool = False) -> DataFrame:
    """``documents`` with repeated paragraphs removed from ``text`` (all columns stay, no row goes).

    With ``report``: also (in place of columns of these names) n_removed, removed_words, removed_spans (byte ranges of the old text) and the sorted ids of the
    documents that hold the first occurrences (first_docs).
    """
    kept = documents.drop(*REPORT) if report else documents
    i, g = C.free(kept, "gone_id", "gone")
    gone = repeats(documents, percent).groupBy(F.col("doc_id").alias(i)).agg(F.collect_list(F.struct("at", "k", "head_doc", "ref")).alias(g))
    both = kept.join(gone, F.col("doc_id").cast("long") == F.col(i), "left").drop(i)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    if report:
        schema += ", n_removed long, removed_words long, removed_spans array<struct<s:long,e:long>>, first_docs array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = C.WordHashes()
        for b in batches:
            i = b.schema.get_field_index("text")
            texts, n, words, spans, firsts = [], [], [], [], []
            for raw, t, g in zip(b.column(i), C.text_bytes(b.column(i)), b.column(b.num_columns - 1).to_pylist(), strict=True):
                out, cut, w = strip(t, {(x["at"], x["k"]): x["ref"] for x in g}, table) if g else (t, [], 0)
                texts.append(out.decode() if raw.is_valid else None)
                n.append(len(cut))
                words.append(w)
                spans.append([{"s": s, "e": e} for s, e in cut])
                firsts.append(sorted({x["head_doc"] for x in g or []}))
            cols = list(b.columns[:-1])
            cols[i] = pa.array(texts, b.schema.field(i).type)
            if report:
                cols += [pa.array(n, pa.int64()), pa.array(words, pa.int64()), pa.array(spans, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), pa.array(firsts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names[:-1], *(REPORT if report else ())])

    return C.arrow(both, run, schema)
