"""BPE encoding by backtracking over Aho-Corasick matches, and decoding through an offset table.

A token sequence is the merge encoding of a word exactly when each pair of neighbours is what merging their joined
text yields (pair compatibility). The encoder walks the word from the left, takes the longest vocabulary match whose
predecessor is compatible with it, shortens on conflict and steps back from dead ends; a position that failed is
never entered again, so a word takes time linear in its length. Words are found as the tokenizer file prescribes
(NFC, white space, lower case, word pattern); words and white-space chunks are memoised in tables of bounded size.

Defined cases: null text is the empty text with no ids; the special tokens' own strings become their single ids;
equal texts have equal rows; extra columns are ignored. A byte outside the vocabulary has no id, as in the library.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common as C

END = "\x00"  # stands for the end-of-word mark inside the automaton's alphabet
_WHITE = r"\t-\r \x85\xa0  -     　"


def byte_alphabet() -> list[str]:
    """Byte -> printable character, the byte-level rule: printable Latin-1 stays, the rest moves to U+0100 and up."""
    stay = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = iter(range(0x100, 0x200))
    return [chr(b) if b in stay else chr(next(moved)) for b in range(256)]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordBPE:
    """Encoder and decoder for a tokenizer file of word-end BPE (lower-cased words, byte-level characters)."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)")
        self.bytes = byte_alphabet()
        strip = lambda t: t[: -len(self.suffix)] + END if t.endswith(self.suffix) else t
        self.ids = {strip(t): i for t, i in model["vocab"].items()}
        self.merges = {(strip(a), strip(b)): n for n, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"])}
        self.text = {i: t for t, i in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            if len(t) - t.endswith(END) == 1 or self.merge(t) == [t]:
                self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + _WHITE + r"\p{L}\p{N}]+")
        self.words: dict[str, bytes] = {}
        self.chunks: dict[bytes, bytes] = {}
        # decoding: token strings end to end, each with the blank that joins it to the next one
        top = max([*model["vocab"].values(), *self.specials.values()], default=-1) + 1
        names = [""] * top
        for t, i in [*model["vocab"].items(), *self.specials.items()]:
            names[i] = t
        parts = [(t + " ").encode() for t in names]
        self.blob = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.length = np.array([len(p) for p in parts], dtype=np.int64)
        self.offset = np.cumsum(self.length) - self.length

    def merge(self, word: str) -> list[str]:
        """Plain merging by rank; only fills tables (is a token its own encoding, are two tokens compatible)."""
        parts = [*word[:-2], word[-2:]] if word.endswith(END) else [*word]
        while len(parts) > 1:
            rank, at = min((self.merges.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) >= C.WORD_TABLE:
                self.pairs.clear()
            x, y = self.text[a], self.text[b]
            got = self.pairs[a, b] = self.merge(x + y) == [x, y]
        return got

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word given as byte-level characters, without the end mark."""
        whole = self.ids.get(word + END)
        if whole is not None and self.merge_is_whole(word):
            return [whole]
        s = word + END
        starts: list[list[tuple[int, int]]] = [[] for _ in range(len(s) + 1)]
        for end, (n, i) in self.automaton.iter(s):
            starts[end - n + 1].append((n, i))
        for c in starts:
            c.sort(reverse=True)
        out: list[int] = []
        at, trail, dead = 0, [iter(starts[0])], set()
        while at < len(s):
            for n, i in trail[-1]:
                if at + n not in dead and (not out or self.compatible(out[-1], i)):
                    out.append(i)
                    at += n
                    trail.append(iter(starts[at]))
                    break
            else:
                dead.add(at)
                trail.pop()
                if not out:
                    # a byte that the vocabulary lacks: as plain merging does it
                    return [self.ids[p] for p in self.merge(s) if p in self.ids]
                at -= len(self.text[out.pop()])
        return out

    def merge_is_whole(self, word: str) -> bool:
        return self.automaton.exists(word + END)

    def word(self, w: str) -> bytes:
        got = self.words.get(w)
        if got is None:
            if len(self.words) >= C.WORD_TABLE:
                self.words.clear()
            got = self.words[w] = np.array(self.encode_word("".join([self.bytes[b] for b in w.encode()])), dtype="<u4").tobytes()
        return got

    def chunk(self, raw: bytes) -> bytes:
        """Ids of a stretch without ASCII white space, as little-endian unsigned 32-bit integers."""
        text = raw.decode("utf-8", "replace")
        out, last = [], 0
        for m in [*self.special.finditer(text), None]:
            part = text[last : m.start() if m else None]
            if part:
                part = part if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ")
                out += map(self.word, self.pattern.findall(part.lower()))
            if m:
                out.append(self.specials[m[0]].to_bytes(4, "little"))
                last = m.end()
        return b"".join(out)

    def encode(self, text: bytes) -> bytes:
        chunks = self.chunks
        try:
            return b"".join([chunks[c] for c in text.split()])
        except KeyError:
            out = []
            for c in text.split():
                ids = chunks.get(c)
                if ids is None:
                    ids = self.chunk(c)
                    if len(c) <= 64:
                        if len(chunks) >= C.WORD_TABLE:
                            chunks.clear()
                        chunks[c] = ids
                out.append(ids)
            return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """Token strings joined by blanks, cut out of the offset table."""
        if not len(ids):
            return b""
        n = self.length[ids]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(self.offset[ids] - (ends - n), n)
        return self.blob[at].tobytes()[:-1]


_loaded: dict[str, WordBPE] = {}


def load(path: str) -> WordBPE:
    if path not in _loaded:
        _loaded[path] = WordBPE(path)
    return _loaded[path]


def encode(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids array<long>, decoded string) of every text."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            ids = [np.frombuffer(bpe.encode(t), dtype="<u4") for t in C.text_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())), pa.array([bpe.decode(x).decode() for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, ids array<long>, decoded string")


def digests(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the same ids and texts, digested where they are made."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            n, hashes, decoded = [], [], []
            for t in C.text_bytes(b.column(1)):
                raw = bpe.encode(t)
                n.append(len(raw) // 4)
                hashes.append(hashlib.sha256(raw).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(np.frombuffer(raw, dtype="<u4"))).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
