"""Near-duplicate detection: one-permutation MinHash, optimal densification, banded buckets, star-shaped candidates.

Each document's distinct 5-word shingles are hashed once into ``BANDS * ROWS`` bins (one permutation); an empty bin
takes the minimum of the first non-empty bin on its own pseudo-random tour of all bins (optimal densification, so a
set of any size fills every bin). ``ROWS`` bins make a band; documents that agree in a band share a bucket. A bucket
is never expanded into pairs: its members are compared with one hub, by one order for all buckets, so that most of a
group's buckets name the same pairs. Exact copies are folded into one node first.

Stars verify each member against its hub only. As two members may be alike though both are unlike the hub, what then
shares a bucket across components, its first hub aside, goes through an exact join: with a fixed order of shingles, rare ones first, two
sets alike share one of the first few, at places that leave enough behind them (prefix and position filter). So all
pairs that share a bucket are decided. Every link is confirmed on the full shingle sets.

Defined cases: null or blank text has no shingles and is linked with nothing; a null doc_id is returned with a null
component_id and kept; rows that repeat a doc_id are separate documents with that id; an empty table gives no rows.
Texts of any length are taken whole. dedup() keeps all columns, whatever their names; of a group it keeps the row with
the least doc_id, among rows with that id the one whose text has the least hash, and of rows that repeat both any one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

ROWS, BANDS = 8, 48
#: Fields of the packed bin key: the bin comes from the high bits of the hash, the value from the rest.
_BINS = ROWS * BANDS
#: Hubs of a bucket in each round of stars; they only leave less to the exact join that follows. In the first round all
#: members have labels of their own, so one hub keeps the join at a row per member and bucket.
STARS = (1, 4)
#: Counters that order shingles by frequency: 8 MB whatever the corpus. Shared counters cost time, never a pair.
CELLS = 1 << 21

_tour_cache: dict[int, np.ndarray] = {}


def tours(bins: int) -> np.ndarray:
    """For each bin, a fixed pseudo-random order of all bins: the attempts of densification, sure to end."""
    if bins not in _tour_cache:
        rng = np.random.Generator(np.random.PCG64(20240917))
        _tour_cache[bins] = np.argsort(rng.random((bins, bins)), axis=1).astype(np.int32)
    return _tour_cache[bins]


def signature(s: np.ndarray, bins: int = _BINS) -> np.ndarray:
    """Densified one-permutation MinHash of distinct hashes ``s`` (not empty)."""
    top = ((s >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    sig = np.full(bins, np.iinfo(np.uint64).max, dtype=np.uint64)
    # s is sorted and the bin grows with it, so the first hash of each bin is its minimum
    first = np.flatnonzero(np.r_[True, top[1:] != top[:-1]])
    sig[top[first].astype(np.int64)] = s[first]
    full = np.zeros(bins, dtype=bool)
    full[top[first].astype(np.int64)] = True
    empty = np.flatnonzero(~full)
    tour, at = tours(bins), 0
    while len(empty):
        span = tour[empty, at : at + 24]
        hit = full[span]
        some = hit.any(axis=1)
        got = empty[some]
        sig[got] = sig[span[some, hit[some].argmax(axis=1)]]
        empty, at = empty[~some], at + 24
    return sig


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    v = sig.reshape(-1, rows)
    acc = np.arange(1, len(v) + 1, dtype=np.uint64)
    for i in range(rows):
        acc = C.mix(acc * np.uint64(0x9E3779B97F4A7C15) + v[:, i])
    return acc


def _set_key(s: np.ndarray) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_intdigest(s.tobytes())
    return d & 0x7FFFFFFFFFFFFFFF, (d >> 64) & 0x7FFFFFFFFFFFFFFF


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = C.WordHashes()
    for b in batches:
        n, keys, bands = [], [], []
        for t in C.text_bytes(b.column(2)):
            s = C.shingles(table.of(C.words_of(t)))
            n.append(len(s))
            if len(s):
                keys.append(_set_key(s)[0])
                bands.append(band_keys(signature(s)).view(np.int64))
            else:
                keys.append(None)
                bands.append(None)
        yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "th", "n", "k", "bands"])


def _sets(bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = C.WordHashes()
        for b in batches:
            b = b.filter(pa.array(C.Sieve.passes(bits.value, b.column(1).to_numpy(), b.column(2).to_numpy()), pa.bool_()))
            keys, sets = [], []
            for t in C.text_bytes(b.column(0)):
                s = C.shingles(table.of(C.words_of(t)))
                if len(s):
                    keys.append(_set_key(s)[0])
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], ["k", "s"])

    return run


def _verify(percent: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), dtype=np.uint64), np.frombuffer(y.as_py(), dtype=np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                both = int((q[at] == p).sum())
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keep, pa.bool_())], ["a", "b", "ok"])

    return check


def _candidate_sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(k, s): the full shingle set of every node that shares a bucket; the scan is thinned out before the join."""
    nodes = C.cut(members.select("k", "rep").distinct())
    sieve = C.Sieve(nodes, "rep")
    sets = C.arrow(docs.select("text", *C.Sieve.places("doc_id")), _sets(sieve.bits), "k long, s binary")
    return C.cut(sets.join(nodes.select("k"), "k", "left_semi").groupBy("k").agg(F.first("s").alias("s")))


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, ok) for ``pairs`` (member a, hub b), decided on the full sets."""
    both = pairs.join(sets.select(F.col("k").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("k").alias("b"), F.col("s").alias("sb")), "b")
    return C.cut(C.arrow(both.select("a", "b", "sa", "sb"), _verify(percent), "a long, b long, ok boolean"))


def _stars(members: DataFrame, orders: list, percent: int) -> DataFrame:
    """Distinct candidate pairs (a, b): in each bucket, the first member by each order with all others.

    Buckets whose members carry one label have nothing left to decide.
    """
    hubs = members.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.array(*[F.min(F.struct(o.alias("o"), "k", "n", "label")) for o in orders]).alias("hubs"))
    hubs = hubs.where("lo <> hi").select("h", F.explode(F.array_distinct(F.transform("hubs", lambda x: F.struct(x.k.alias("k"), x.n.alias("n"), x.label.alias("label"))))).alias("hub"))
    near = f"label <> hub.label and 100 * least(n, hub.n) >= {percent} * greatest(n, hub.n)"
    return members.join(hubs, "h").where(near).select(F.least("k", "hub.k").alias("a"), F.greatest("k", "hub.k").alias("b")).distinct()


def _frequencies(have: DataFrame):
    """Broadcast counters of the shingles of all sets, by their low bits."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CELLS, dtype=np.int64)
        for b in batches:
            n += np.bincount((np.frombuffer(b"".join(b.column(0).to_pylist()), dtype=np.uint64) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["cell", "n"])

    got = C.arrow(have.select("s"), count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1").toArrow()  # CELLS rows at most
    n = np.ones(CELLS, dtype=np.int32)
    n[got.column("cell").to_numpy()] = np.minimum(got.column("n").to_numpy(), np.iinfo(np.int32).max)
    return have.sparkSession.sparkContext.broadcast(n)


def _prefixes(frequencies, percent: int):
    """(t, label, k, n, i): the i-th shingles t, rare ones first, of which sets alike must share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = frequencies.value
        for b in batches:
            who, n, at, token = [], [], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
            for raw in b.column(2).to_pylist():
                s = np.frombuffer(raw, dtype=np.uint64)
                c = f[(s & np.uint64(CELLS - 1)).astype(np.int64)]
                first = np.lexsort((s, c))[: len(s) + 1 + -percent * len(s) // 100]
                i = np.flatnonzero(c[first] > 1)
                who.append(len(i))
                n.append(len(s))
                at.append(i)
                token.append(s[first[i]])
            row = np.repeat(np.arange(len(who)), who)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64)), b.column(1).take(pa.array(row)), b.column(0).take(pa.array(row)), pa.array(np.array(n, dtype=np.int64)[row]), pa.array(np.concatenate(at))], ["t", "label", "k", "n", "i"])

    return run


def _cross(percent: int, block: int = 1 << 17):
    """Rows sorted by (t, label): pairs of a shingle's members under different labels that pass the position filter."""

    def pairs(t, label, k, n, i):
        edge = np.r_[True, t[1:] != t[:-1]]
        part = edge | np.r_[True, label[1:] != label[:-1]]
        span = lambda new: (np.flatnonzero(new)[np.cumsum(new) - 1], np.r_[np.flatnonzero(new)[1:], len(new)][np.cumsum(new) - 1])
        (g0, g1), (l0, l1) = span(edge), span(part)
        # the smaller set of a pair alike has the shared shingle among fewer than the larger one
        few = np.flatnonzero(i < n + 1 + -2 * percent * n // (100 + percent))
        for lo, hi in ((g0, l0), (l1, g1)):
            size = hi[few] - lo[few]
            row, start, size = few[size > 0], lo[few][size > 0], size[size > 0]
            end = np.cumsum(size)
            at = 0
            while at < (end[-1] if len(end) else 0):
                j = np.arange(at, min(at + block, end[-1]))
                r = np.searchsorted(end, j, side="right")
                x, y = row[r], start[r] + j - (end - size)[r]
                need = -(-percent * (n[x] + n[y]) // (100 + percent))
                ok = np.minimum(n[x] - i[x], n[y] - i[y]) >= need
                x, y = k[x[ok]], k[y[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])
                at += block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # the batches of the last shingle, which may go on
        for b in batches:
            cols = [c.to_numpy() for c in b.columns]
            if not len(cols[0]):
                continue
            if held and cols[0][-1] == held[0][0][-1]:
                held.append(cols)
                continue
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            yield from pairs(*(np.concatenate([h[c] for h in held] + [cols[c][:last]]) for c in range(5)))
            held = [[c[last:] for c in cols]]
        if held:
            yield from pairs(*(np.concatenate([h[c] for h in held]) for c in range(5)))

    return run


def _exact(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) with different labels, among nodes of buckets that hold several labels: all that can be alike.

    The first round of stars has decided every pair with a bucket's first hub, so the hub stands aside: what chance puts
    into a bucket by twos, which grows with the square of the corpus, has nothing left to decide.
    """
    hubs = members.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("c"), F.min(F.struct((-F.col("degree")).alias("o"), "k")).alias("hub"))
    rest = members.join(hubs.where("c > 2 and lo <> hi").select("h", F.col("hub.k").alias("hub")), "h").where("k <> hub")
    split = rest.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("h")
    have = C.cut(rest.join(split, "h", "left_semi").select("k", "label").distinct().join(sets, "k").select("k", "label", "s"))
    rows = C.arrow(have, _prefixes(_frequencies(have), percent), "t long, label long, k long, n long, i long")
    return C.arrow(rows.repartition("t").sortWithinPartitions("t", "label"), _cross(percent), "a long, b long").distinct()


def _grow(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """``comp`` (node, label) with more links: links between components, then new labels for old ones."""
    if comp is None:
        return C.components(links)
    at = lambda c: comp.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    ends = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    grown = C.components(ends)
    moved = grown.select(F.col("node").alias("label"), F.col("label").alias("to"))
    old = comp.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return C.cut(old.union(grown.join(comp.select("node"), "node", "left_anti").select("node", "label")))


def clusters(wide: DataFrame, sets: DataFrame, percent: int, stars: tuple[int, ...] = STARS) -> DataFrame | None:
    """(node, label) of all nodes linked with another, or None: ``wide`` is (h, k, n, degree), ``sets`` (k, s)."""
    comp = tried = None
    used = []
    members = wide.select("h", "k", "n", "degree", F.col("k").alias("label"))
    for turn in range(len(stars) + 1):
        if turn < len(stars):
            orders = [F.xxhash64("k", F.lit(turn), F.lit(i)) for i in range(stars[turn])]
            pairs = _stars(members, [-F.col("degree"), *orders[1:]] if turn == 0 else orders, percent)
        else:
            pairs = _exact(members, sets, percent)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        done = _confirm(pairs, sets, percent)
        used.append(done)
        links = done.where("ok").select("a", "b")
        tried = done.select("a", "b") if tried is None else tried.union(done.select("a", "b"))
        if links.isEmpty():
            continue
        comp = _grow(comp, links)
        members = wide.join(comp.withColumnRenamed("node", "k"), "k", "left").select("h", "k", "n", "degree", F.coalesce("label", "k").alias("label"))
        C.release(wide.sparkSession)
    C.drop(*used)
    return comp


def widen(members: DataFrame, small: DataFrame) -> DataFrame:
    """``members`` (h, k, c) with the columns of ``small`` and a degree, the sizes of the member's buckets.

    The member that shares most buckets with most others is likely what the others were copied from: the first hub.
    """
    degree = members.groupBy("k").agg(F.sum("c").alias("degree"))
    return C.cut(members.select("h", "k").join(degree.join(small, "k"), "k"))


def assign(documents: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, th, n, component_id, head_th), one row per document; th is the hash of the text.

    A component's head is its least (doc_id, th). Links need 100 * |A and B| >= percent * |A or B|.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = C.arrow(docs.select("doc_id", F.xxhash64("text").alias("th"), "text"), _signatures, "doc_id long, th long, n long, k long, bands array<long>")
    sig = C.cut(sig)
    nodes = C.cut(sig.where("n > 0 and doc_id is not null").groupBy("k").agg(F.min(F.struct("doc_id", "th")).alias("head"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    of_doc = C.cut(sig.select("doc_id", "th", "n", "k"))
    C.drop(sig)
    rows = nodes.select(F.explode("bands").alias("h"), "k")
    members = C.cut(rows.join(rows.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "h"))
    small = C.cut(nodes.select("k", "head", F.col("head.doc_id").alias("rep"), "n"))
    C.drop(nodes)
    wide = widen(members, small.select("k", "rep", "n"))
    C.drop(members)
    C.release(spark)
    sets = _candidate_sets(docs, wide)
    comp = clusters(wide, sets, percent)
    C.drop(sets, wide)
    least = small.select("k", "head", F.col("k").alias("label"))
    if comp is not None:
        least = small.join(comp.withColumnRenamed("node", "k"), "k", "left").select("k", "head", F.coalesce("label", "k").alias("label"))
    # a table of its own, so that the join on a label that many nodes share can be split
    heads = C.cut(least.groupBy("label").agg(F.min("head").alias("first")))
    least = C.cut(least.join(heads, "label").select("k", F.col("first.doc_id").alias("component_id"), F.col("first.th").alias("head_th")))
    C.drop(heads, small)
    out = of_doc.join(least, "k", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "th", "n", component.alias("component_id"), F.coalesce("head_th", "th").alias("head_th"))


def near_duplicates(documents: DataFrame, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    own = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return assign(documents, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id", own.alias("kept"))


def dedup(documents: DataFrame, percent: int = 80) -> DataFrame:
    """``documents`` with one row of each group of near-duplicates; rows without words or id all stay."""
    i, t, th = C.free(documents, "dup_id", "dup_th", "text_hash")
    rows = C.cut(assign(documents, percent).where("doc_id is not null and n > 0"))
    head = "doc_id = component_id and th = head_th"
    gone = rows.where(f"not ({head})").select(F.col("doc_id").alias(i), F.col("th").alias(t)).distinct()
    again = rows.where(head).groupBy(F.col("doc_id").alias(i), F.col("th").alias(t)).agg(F.count("*").alias("c")).where("c > 1").drop("c")
    same = (F.col("doc_id").cast("long") == F.col(i)) & (F.col(th) == F.col(t))
    kept = documents.withColumn(th, F.xxhash64(F.col("text").cast("string"))).join(gone, same, "left_anti")
    if not again.isEmpty():
        kept = kept.join(again, same, "left_anti").union(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", th]))
    return kept.drop(th)
