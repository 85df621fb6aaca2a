"""Packing documents into fixed-length training sequences by shortest-pack-first over the length histogram.

Every document is its token ids and one end id. Whole sequences are cut off its front; the rest, shorter than a
sequence, is packed. Only the histogram of piece lengths (at most ``size`` numbers) reaches the driver. There lengths
are placed longest first into the pack with the most room left (the shortest pack), as counts of packing patterns.
Pieces then find their place by rank: the r-th piece of a length goes to the pattern slot that covers rank r. Ranks
come from counts per (length, salt), so a length that a third of all pieces share is never ranked in one task.

Padding: a sequence is padded to ``size`` unless it fills a power of two exactly. Where lengths leave more than ``ROOM``
of the places empty, the least filled packs are taken apart again, as counts: their pieces are cut and fill the gaps of
the others, the largest gap first. As many packs go as the room allows, so every histogram ends near ``ROOM`` or below.
The ids of such pieces travel with them to their place, those of all others do not.

Defined cases: null text is empty (one piece with the end id alone); rows that repeat a doc_id are separate documents;
a null doc_id stays null; pieces of equal length are ranked by doc_id, start and the hash of their ids; texts of any
length are encoded whole; columns but doc_id and text are not looked at; an empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SIZE = 1024
END_ID = 0
#: Share of empty places from which on packs are taken apart.
ROOM = 0.004


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteBPE:
    """Ids as the tokenizers library gives them for a byte-level file.

    The same vocabulary runs in a faster encoder where the file allows it (no normaliser, the byte-level pattern,
    token ids in merge order); texts that hold a special token's string, and other files, go to the library itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        from .bpe import byte_alphabet

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        vocab, merges = model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        ids = [vocab["".join(m)] for m in merges]
        self.fast = None
        if spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and ids == sorted(ids) and not model.get("ignore_merges"):
            back = {c: i for i, c in enumerate(byte_alphabet())}
            special = {t["content"] for t in spec["added_tokens"]}
            ranks = {bytes([back[c] for c in t]): i for t, i in vocab.items() if t not in special}
            pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
            self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe

    def encode(self, text: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        t = text.decode("utf-8", "replace")
        if self.fast is None or any(s in text for s in self.special):
            ids = self.tok.encode(t, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(t)
        return np.array(ids, dtype="<u4").tobytes()


_loaded: dict[str, ByteBPE] = {}


def load(path: str) -> ByteBPE:
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


def pieces(documents: DataFrame, size: int = SIZE, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, ids): whole sequences and the rest of every document.

    ``ids`` is kept for what may still be cut, in two bytes each if they fit; null for whole sequences.
    """
    path = vocabulary or default_vocabulary()
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            whom, rows, kept = [], ([], [], [], []), []
            for d, text in enumerate(C.text_bytes(b.column(1))):
                raw = bpe.encode(text) + end
                n = len(raw) // 4
                for at in range(0, n, size):
                    part = raw[4 * at : 4 * (at + size)]
                    whom.append(d)
                    kept.append(None if len(part) == 4 * size else _short(part))
                    for out, v in zip(rows, (at, len(part) // 4, zlib.crc32(part), n), strict=True):
                        out.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(whom, pa.int64())), *(pa.array(x, pa.int64()) for x in rows), pa.array(kept, pa.binary())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return C.arrow(documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def _short(raw: bytes) -> bytes:
    ids = np.frombuffer(raw, dtype="<u4")
    return ids.astype("<u2").tobytes() if ids.max(initial=0) < 1 << 16 else raw


def _long(ids: bytes, n: int) -> bytes:
    return np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes() if len(ids) == 2 * n else ids


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, list[int]]]:
    """(how many sequences, lengths in order): every length's count is used up; longest first, into the shortest pack."""
    room: dict[int, list[list]] = defaultdict(list)  # room left -> [count, lengths]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        for space in range(size, length - 1, -1):
            if not left:
                break
            if space not in room:
                continue
            stay = []
            for count, parts in room.pop(space):
                n = min(left, count)
                if n:
                    room[space - length].append([n, [*parts, length]])
                    left -= n
                if count > n:
                    stay.append([count - n, parts])
            if stay:
                room[space] += stay
        if left:
            # no pack has room: open packs, as many pieces of this length in each as fit
            full, rest = divmod(left, size // length)
            for count, parts in ((full, [length] * (size // length)), (1, [length] * rest)):
                if count and parts:
                    room[size - length * len(parts)].append([count, parts])
    return [(count, parts) for space in sorted(room) for count, parts in room[space]]


def slots(plan: list[tuple[int, list[int]]], size: int = SIZE, room: float = ROOM) -> list[tuple[int, int, list[tuple[int, int, int, int]]]]:
    """(length, how many, fragments (first sequence, offset, start, length)): so many pieces of a length, the k-th of which
    lies in sequences first + k, whole or in fragments. Sequences are numbered from 0 without gaps."""
    total, packs = sum(n * sum(parts) for n, parts in plan), sum(n for n, _ in plan)
    most = max(-(-total // size), int(total / (size * (1 - room))))
    too_many = max(0, packs - most)
    out, gaps, loose, first = [], [], [], 0  # gaps: (-gap, first sequence, how many)
    for count, parts in sorted(plan, key=lambda x: (sum(x[1]), x[1])):  # the least filled go
        apart = min(count, too_many)
        too_many -= apart
        count -= apart
        loose += [(apart, length) for length in parts if apart]
        offset = 0
        for length in parts if count else ():
            out.append((length, count, [(first, offset, 0, length)]))
            offset += length
        if count and offset < size:
            heapq.heappush(gaps, (offset - size, first, count))
        first += count
    work = [(n, length, 0, []) for n, length in sorted(loose, key=lambda x: x[1])]
    while work:
        n, length, start, parts = work.pop()
        gap, at, count = heapq.heappop(gaps)
        m, part = min(n, count), min(-gap, length - start)
        if n > m:  # the others try the next gap
            work.append((n - m, length, start, [(f + m, o, s, k) for f, o, s, k in parts]))
        if count > m:
            heapq.heappush(gaps, (gap, at + m, count - m))
        if part < -gap:
            heapq.heappush(gaps, (gap + part, at, m))
        parts = [*parts, (at, size + gap, start, part)]
        if start + part < length:
            work.append((m, length, start + part, parts))
        else:
            out.append((length, m, parts))
    return out


def pack(documents: DataFrame, size: int = SIZE, vocabulary: str | None = None) -> DataFrame:
    """pieces() with the sequence each lies in and its offset there; sequence ids and offsets have no gaps."""
    spark = documents.sparkSession
    cut = C.cut(pieces(documents, size, vocabulary))
    salts = max(8, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = C.cut(cut.groupBy("length", "salt").agg(F.count("*").alias("n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    places = slots(patterns(histogram, size), size)
    order = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "salt", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    split = sorted({length for length, _, parts in places if len(parts) > 1})  # at most `size` numbers
    ids = F.when(F.col("length").isin(*split), F.col("ids")) if split else F.lit(None).cast("binary")
    ranked = cut.withColumn("ids", ids).withColumn("r", F.row_number().over(within) - 1).join(before, ["length", "salt"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("r") + F.col("before")).alias("rank"), "ids")
    places.sort(key=lambda x: x[0])
    lengths, sizes = np.array([p[0] for p in places], dtype=np.int64), np.array([p[1] for p in places], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    begins -= begins[np.searchsorted(lengths, lengths)] if len(places) else 0  # first rank of each, within its length
    many = np.array([len(p[2]) for p in places], dtype=np.int64)
    parts = np.array([f for p in places for f in p[2]], dtype=np.int64).reshape(-1, 4)
    heads = np.cumsum(many) - many
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = np.int64(1) << 44
        keys = lengths * wide + begins
        for b in batches:
            length, rank = b.column(2).to_numpy(), b.column(5).to_numpy()
            slot = np.searchsorted(keys, length * wide + rank, side="right") - 1
            row = np.repeat(np.arange(len(slot)), many[slot])
            nth = np.arange(len(row)) - np.repeat(np.cumsum(many[slot]) - many[slot], many[slot])
            p = parts[heads[slot][row] + nth]
            crc = b.column(3).to_numpy()[row]
            for i in np.flatnonzero(many[slot][row] > 1):
                raw = _long(b.column(6)[int(row[i])].as_py(), int(length[row[i]]))
                crc[i] = zlib.crc32(raw[4 * p[i, 2] : 4 * (p[i, 2] + p[i, 3])])
            which = pa.array(row)
            start = b.column(1).to_numpy()[row] + p[:, 2]
            sequence = p[:, 0] + (rank - begins[slot])[row]
            yield pa.RecordBatch.from_arrays([b.column(0).take(which), pa.array(start), pa.array(p[:, 3]), pa.array(crc), b.column(4).take(which), pa.array(sequence), pa.array(p[:, 1])], names)

    return C.arrow(ranked, place, ", ".join(f"{n} long" for n in names))
