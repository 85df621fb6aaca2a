"""Corpus operators against brute force, round trips, libraries and held-out accuracy; edge rows for all of them."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from vigil.llm import bpe, common, fingerprint, licenses, lm, media, minhash, packing, quality, queries, substring, toxicity

from ..compare import same
from ..conftest import SF

SCHEMA = "doc_id long, text string, k string, rep long, n long, label int, n_removed int"
rng = random.Random(3)
WORDS = ["w%d" % i for i in range(300)]
BASE = [" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(4)]
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "É ñ 漢字 😀 \x00 x"), (7, "a b c d e"), (8, "A B C D E"), (9, "word " * 3000), (10, BASE[0]), (11, BASE[0] + " tail"), (12, BASE[1]), (12, BASE[1]), (None, BASE[0]), (13, "line\n" + BASE[2] + "\nend"), (14, BASE[2]), (15, "All rights reserved. <|endoftext|>")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, 4) for i, t in EDGE], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows, percent):
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i, _ in sets}


def test_op1_sql(spark, duck):
    same(queries.op1_minhash_near_dedup(spark, SF), duck.sql(queries.OP1_SQL))


def test_op1_edges(spark, edge, none):
    want = brute_components(EDGE, 85)
    got = minhash.near_duplicates(edge).collect()
    assert len(got) == len(EDGE)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    assert minhash.near_duplicates(none).count() == 0


def test_op1_chains_and_groups(spark):
    """A group whose members drift apart, so that the hub is unlike its far members."""
    r = random.Random(5)
    rows, words = [], [r.choice(WORDS) for _ in range(120)]
    for i in range(40):
        rows.append((i, " ".join(words)))
        words[r.randrange(120)] = "new%d" % i
    rows += [(100 + i, " ".join([*(r.choice(WORDS) for _ in range(3)), *BASE[0].split()])) for i in range(30)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x.doc_id: x.component_id for x in got.collect()} == brute_components(rows, 85)


def test_op1_template(spark):
    """Pairs whose only common buckets are those of a template that many unlike documents share."""
    r = random.Random(11)
    template = [f"t{i}" for i in range(400)]
    rows = [(i, " ".join([*template, *(f"u{i}x{j}" for j in range(41))])) for i in range(1500)]
    for i in range(40):
        w = rows[i][1].split()
        w[r.randrange(150, 250)] = "edit"
        w[400 + r.randrange(10, 30)] = "edit"
        rows.append((5000 + i, " ".join(w)))
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i % 5000 for i, _ in rows}


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    want = {x: find(x) for p in pairs if p[0] != p[1] for x in p}
    assert {x.node: x.label for x in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()} == want


@pytest.mark.parametrize("op,module,least", [("op2_toxicity", toxicity, 0.8), ("op10_quality", quality, 0.9)])
def test_classifiers(spark, edge, none, op, module, least):
    column = {"op2_toxicity": "toxic", "op10_quality": "quality"}[op]
    sf = "/root/testdata/sf0.01"
    got = getattr(queries, op)(spark, sf).collect()
    label = {r.doc_id: r[column] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in got if r.held_out and label.get(r.doc_id) is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    assert sum(r.predicted == label[r.doc_id] for r in held) / len(held) >= least
    labels = spark.createDataFrame([(4, 1, 0), (10, 0, 1), (None, 1, 1), (12, None, None)], "doc_id long, quality int, toxic int")
    model = module.fit(edge, labels, column)
    assert module.score(edge, model).count() == len(EDGE)
    assert module.keep(edge, model).columns == edge.columns
    empty = module.fit(none, labels.limit(0), column)
    assert module.score(none, empty).count() == 0 and module.score(edge, empty).where("score is null").count() == 0


def test_label_model():
    """Votes of known accuracy, two of them copies: the posterior beats the flawed given labels."""
    r = np.random.default_rng(0)
    y = (r.random(4000) < 0.3).astype(int)
    flip = lambda p: np.where(r.random(4000) < p, 1 - y, y)
    a = flip(0.1)
    v = np.column_stack([a, a, flip(0.15), flip(0.2), flip(0.2)])
    given = flip(0.2)
    assert ((toxicity.label_model(v, given) > 0.5) == y).mean() > max(0.9, (given == y).mean() + 0.08)


def test_op3_matches_library(spark, edge, none, docs):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    alphabet = "abc'sStTrReEvVmMlLdD .,!\n\t09İΣσςéÉßﬁ漢字　\x85\xa0\x1c😀٣½²“-<|endoftext|>\0"
    odd = [(1000 + i, "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 30)))) for i in range(400)]
    rows = [(i, t) for i, t in EDGE if i] + odd + [(i + 10_000, t) for i, t in docs.items()][:60]
    got = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        t = text[r.doc_id]
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == tok.decode(ids, skip_special_tokens=False)
    d = {r.doc_id: r for r in bpe.digests(edge).collect()}
    ids = tok.encode(BASE[1], add_special_tokens=False).ids
    assert d[12].ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest() and d[1].n_tokens == 0
    assert bpe.digests(none).count() == 0


def test_op4(spark, edge, none, docs):
    got = {r.doc_id: r for r in queries.op4_fingerprint(spark, SF).collect()}
    ids, err = sorted(docs), []
    for n, i in enumerate(ids):
        t, nxt = docs[i], docs[ids[(n + 1) % len(ids)]]
        h = len(t) // 2
        e = t[: len(t) - h] + nxt[:h]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        a, b = shingle_set(t), shingle_set(e)
        err.append(got[i].near_edited - len(a & b) / max(1, len(a | b)))
    assert np.sqrt(np.mean(np.square(err))) < 0.05 and abs(np.mean(err)) < 0.01
    f = {}
    for r in fingerprint.fingerprints(edge).collect():
        f.setdefault(r.doc_id, r.fingerprint)
    assert f[4] == f[5] and f[7] == f[8] and f[1] == f[2] == f[3] == ""
    assert fingerprint.edited_pairs(edge).count() == len(EDGE) and fingerprint.edited_pairs(none).count() == 0
    one = fingerprint.edited_pairs(edge.where("doc_id = 10")).first()
    assert one.near_next == 1.0


def plain_fingerprint(text: str) -> str:
    """One bin after the other, in plain Python."""
    mask, low, bins = (1 << 64) - 1, (1 << 52) - 1, fingerprint.BINS
    long = lambda v, seed: xxhash.xxh64(v.to_bytes(8, "little"), seed=seed).intdigest()
    words = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in re.split("[ \\x09-\\x0D]+", text.lower().strip(" \t\n\x0b\x0c\r")) if w]
    size = fingerprint.SHINGLE
    held: list[int | None] = [None] * bins
    for i in range(max(1, len(words) - size + 1) if words else 0):
        h = 42
        for w in words[i : i + size]:
            h = long(w, h) & mask
        b, v = h >> 56, h & low
        held[b] = v if held[b] is None else min(held[b], v)
    if not words:
        return ""
    rng = np.random.Generator(np.random.PCG64(7))
    start, step = rng.integers(0, bins, bins), rng.integers(0, bins // 2, bins) * 2 + 1
    for tries in [fingerprint._TRIES] * fingerprint._PASSES + [bins]:
        seen = held[:]
        for b in range(bins):
            if seen[b] is None:
                places = [int(start[b] + k * step[b]) % bins for k in range(tries)]
                held[b] = next((seen[p] for p in places if seen[p] is not None), None)
    return "".join(f"{v & 255:02x}" for v in held)


def test_op4_fingerprints_are_exact(spark, docs):
    texts = [*docs.values(), *[t for _, t in EDGE], "a", "A b", "a b c d e f", " x\ty  z\n", "one two three four five six seven " * 3]
    got = fingerprint.fingerprints(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.fingerprint == plain_fingerprint(texts[r.doc_id] or "")


def test_op5(spark, edge, none, docs):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    rows = [(i, t) for i, t in EDGE] + [(i + 10_000, t) for i, t in docs.items()] + [(900, "cc by CC-BY all rights reserved x general public license"), (901, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the 'Software'), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so")]
    got = licenses.summary(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text[r.doc_id]))
        at = [(i, lab) for p, lab in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert {r.doc_id: r.labels for r in got}[901] == "mit"
    assert licenses.summary(licenses.scan(none)).count() == 0


def test_op5_matching_statistics():
    """Longest match ending at each word and its places, against brute force; a licence with other words in it is spanned."""
    r = random.Random(37)
    for _ in range(30):
        seqs = [[r.randrange(1, 4) for _ in range(r.randrange(6, 25))] for _ in range(4)]
        auto = licenses.Automaton(seqs)
        state = n = 0
        text = [r.randrange(1, 5) for _ in range(60)]
        for i, w in enumerate(text):
            while state and w not in auto.next[state]:
                state = auto.link[state]
                n = auto.length[state]
            state, n = (auto.next[state][w], n + 1) if w in auto.next[state] else (0, 0)
            want = max(k for k in range(i + 2) if k == 0 or any(s[j : j + k] == text[i + 1 - k : i + 1] for s in seqs for j in range(len(s))))
            assert n == want
            if n >= licenses.LONG:
                places = {t: [j + n - 1 for j in range(len(s)) if s[j : j + n] == text[i + 1 - n : i + 1]] for t, s in enumerate(seqs)}
                assert auto.at[state] == {t: p for t, p in places.items() if p}
    s = licenses.scanner()
    label, whole = next(x for x in licenses.TEMPLATES if x[0] == "bsd-3-clause")
    w = licenses.words(whole.encode())
    for i in range(20, len(w), 40):
        w[i] = b"otherword"
    _, _, spans = s.scan(b"before it " + b" ".join(w) + b" after it")
    assert any(x.label == label and x.start == 2 and x.end == 2 + len(w) and x.cover > 0.9 for x in spans)
    twice = licenses.Scanner((("t", "a b c d e f g a b c d e h i"),)).scan(b"a b c d e f g a b c d e h i")[2]
    assert [(x.start, x.end, x.cover) for x in twice] == [(0, 14, 1.0)]


def plain_spans(templates, text):
    """Spans by trying everything: for each template and each end the longest match, those that cannot go on, their best chains."""
    out = []
    for label, t in templates:
        t = t.split()
        longest = []  # per end: length of the longest match that counts
        for e in range(len(text) + 1):
            n = max((k for k in range(min(e, len(t)) + 1) if k and any(t[p : p + k] == text[e - k : e] for p in range(len(t) - k + 1))), default=0)
            longest.append(n if n >= licenses.LONG or n == len(t) else 0)
        found = []
        for e, n in enumerate(longest):
            if n and (e == len(text) or longest[e + 1] != n + 1):
                found += [(e - n, e, p) for p in range(len(t) - n + 1) if t[p : p + n] == text[e - n : e]]
        found.sort(key=lambda m: (m[1], m[0], m[2]))
        best, head = [], []
        for s, e, p in found:
            b, h = e - s, s
            for (s0, e0, p0), b0, h0 in zip(found, best, head):
                if s0 < s and e0 < e and p0 < p and e0 >= s - licenses.GAP and b0 + e - max(s, e0) > b:
                    b, h = b0 + e - max(s, e0), h0
            best.append(b)
            head.append(h)
        most = [x for x in best if x >= licenses.COVER * len(t)]
        out += [(label, max(most) / len(t))] if most else []
    return out


def test_op5_by_hand():
    """Labels, best covers and score on random templates that share beginnings, ends and parts."""
    r = random.Random(41)
    for _ in range(120):
        common = [[r.choice("abcdefgh") for _ in range(r.randrange(2, 12))] for _ in range(4)]
        templates = tuple((f"t{i}", " ".join(w for _ in range(r.randrange(1, 4)) for w in r.choice(common)) if i else r.choice(["a", "a b", "h g"])) for i in range(5))
        text = [w for _ in range(r.randrange(1, 6)) for w in [*r.choice(common), *(["zz"] * r.randrange(3))]]
        spans = licenses.Scanner(templates).scan(" ".join(text).encode())[2]
        want = plain_spans(templates, text)
        assert {s.label for s in spans} == {label for label, _ in want}, (templates, text)
        for label, cover in want:
            assert max(s.cover for s in spans if s.label == label) == min(1.0, cover)


def test_op5_ends_of_matches():
    one, two = " ".join(f"a{i}" for i in range(13)), " ".join(f"b{i}" for i in range(13))
    three = " ".join(f"c{i}" for i in range(13))
    spans = licenses.Scanner((("one", f"{one} {two}"), ("two", f"{one} {three}"))).scan(f"{one} b0 {three}".encode())[2]
    assert [(s.label, s.start, s.end) for s in spans if s.label == "two"] == [("two", 0, 27)]
    text = {x[0]: x[1] for x in licenses.TEMPLATES if len(x[1]) > 400}
    labels = lambda t: {s.label for s in licenses.scanner().scan(t.encode())[2]}
    assert {"bsd", "bsd-3-clause"} <= labels(text["bsd-3-clause"]) and {"mit", "as-is"} <= labels(text["mit"])
    short = licenses.Scanner((("mit", "mit license"), ("gpl", "gpl"), ("x", "the mit license text that goes on")))
    assert [(s.label, s.start, s.end, s.cover) for s in short.scan(b"see the MIT license. Or GPL")[2]] == [("mit", 2, 4, 1.0), ("gpl", 5, 6, 1.0)]


def test_op5_folder(spark, tmp_path):
    (tmp_path / "My-License.txt").write_text("one two three four five six seven eight nine ten eleven twelve")
    texts = licenses.folder_templates(spark, str(tmp_path))
    assert [t[0] for t in texts] == ["my-license"]
    docs = spark.createDataFrame([(1, "so one two three four five six x eight nine ten eleven twelve"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.summary(licenses.scan(docs, texts)).collect()} == {1: "my-license", 2: ""}


def test_op6(spark, edge, none):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    long = [(50 + i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 2500)))) for i in range(60)]
    rows = [(i, t) for i, t in EDGE if i != 12] + long
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    for i, t in rows:
        if i is None:
            continue
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        mine = got[got.doc_id == i].sort_values("start")
        assert mine.length.sum() == len(ids) and (mine.doc_tokens == len(ids)).all()
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(mine.start, mine.length)] == [*mine.ids_crc32]
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert [*s.offset] == [*(s.length.cumsum() - s.length)] and s.length.sum() <= 1024
    assert sorted(got.sequence_id.unique()) == [*range(got.sequence_id.nunique())]
    assert packing.pack(none).count() == 0 and packing.pack(edge).count() >= len(EDGE)


def test_op6_histogram():
    h = {n: rng.randint(1, 40) for n in range(1, 1024, 7)}
    used = collections.Counter()
    for count, parts in packing.patterns(h):
        assert sum(parts) <= 1024
        for p in parts:
            used[p] += count
    assert used == h


def test_op6_padding():
    """A third of all rows of one length: sequences are filled, not opened for one piece each."""
    assert packing.patterns({100: 1000}) == [(100, [100] * 10)]
    for hot, top in ((200, 250), (400, 500)):
        h = collections.Counter(rng.randint(20, top) for _ in range(20_000)) + collections.Counter({hot: 10_000})
        used, plan = collections.Counter(), packing.patterns(h)
        for count, parts in plan:
            assert sum(parts) <= 1024
            for p in parts:
                used[p] += count
        assert used == h
        assert sum(n * p for p, n in h.items()) >= 0.94 * 1024 * sum(c for c, _ in plan)


def test_op6_cuts():
    """Any histogram is packed into few sequences, every place of every piece once, every sequence without gaps."""
    wide = {"600-699": range(600, 700), "341": (341, 342), "350-511": range(350, 512), "260-330": range(260, 331), "1": (1,), "513": (513,), "1024": (1024,), "mixed": range(1, 1025)}
    for name, lengths in wide.items():
        for n in (1, 3, 700, 100_000):
            h = collections.Counter(rng.choice(lengths) for _ in range(min(n, 20_000)))
            h = {k: v * -(-n // 20_000) for k, v in h.items()}
            total, pieces, filled = sum(k * v for k, v in h.items()), collections.Counter(), collections.defaultdict(list)
            for length, many, parts in packing.slots(packing.patterns(h)):
                pieces[length] += many
                assert [s for _, _, s, _ in parts] == [sum(x[3] for x in parts[:i]) for i in range(len(parts))] and sum(x[3] for x in parts) == length
                for first, offset, _, k in parts:
                    filled[offset, k].append((first, many))
            assert pieces == h
            ends = max(f + m for v in filled.values() for f, m in v)
            used = np.zeros((ends, 2), dtype=np.int64)  # places, and the sum of offsets that a gapless sequence has
            for (offset, k), v in filled.items():
                for f, m in v:
                    used[f : f + m, 0] += k
                    used[f : f + m, 1] += 2 * offset * k + k * k
            assert (used[:, 0] <= 1024).all() and (used[:, 0] > 0).all() and (used[:, 1] == used[:, 0] ** 2).all()
            assert ends <= max(-(-total // 1024), total / 1024 * 1.005), name


def test_op6_fragments(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(170, 230)))) for i in range(150)] + [(7, None), (8, "x " * 400_000)]
    got = packing.pack(spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, length int, ids string").repartition(3)).toPandas()
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        mine = got[(got.doc_id == i) & (got.doc_tokens == len(ids))].sort_values("start")
        assert [*mine.start] == [*(mine.length.cumsum() - mine.length)] and mine.length.sum() == len(ids)
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(mine.start, mine.length)] == [*mine.ids_crc32]
    seqs = got.sort_values("offset").groupby("sequence_id")
    for _, s in seqs:
        assert [*s.offset] == [*(s.length.cumsum() - s.length)] and s.length.sum() <= 1024
    assert got.length.sum() >= 0.98 * 1024 * len(seqs) and [*sorted(got.sequence_id.unique())] == [*range(len(seqs))]


def test_op7(spark, edge, none, docs):
    got = queries.op7_lm_score(spark, SF).collect()
    tok = {i: [*ascii_lower(t).encode().split(), None] for i, t in docs.items()}
    c = collections.Counter(w for i, x in tok.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in x)
    n, v = sum(c.values()), len(c)
    for r in got:
        x = tok[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(x), sum(c[w] > 0 for w in x), n, zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x), rel_tol=1e-9)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm.score(edge).count() == len(EDGE) and lm.score(none).count() == 0


def test_op7_score_is_exact(spark, docs, monkeypatch):
    """Scores against the model's forward recursion in logarithms, word by word, with most words outside the head table."""
    kept, train = [], lm.baum_welch
    monkeypatch.setattr(lm, "HEAD", 5000)
    monkeypatch.setattr(lm, "baum_welch", lambda coded: kept.append(train(coded)) or kept[-1])
    got = {r.doc_id: r.score for r in queries.op7_lm_score(spark, SF).collect()}
    tok = {i: ascii_lower(t).encode().split() for i, t in docs.items()}
    c = collections.Counter(w for i, x in tok.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in x)
    top = {w: 1 + k for k, w in enumerate(sorted(c, key=lambda w: (-c[w], w))[: lm.SYMBOLS])}
    n, v = collections.Counter(), collections.Counter()
    for w in c.keys() - top.keys():
        n[lm.word_class(w)] += c[w]
        v[lm.word_class(w)] += 1
    m = kept[0]
    assert np.allclose(m.emit.sum(axis=0), 1) and np.allclose(m.trans.sum(axis=1), 1) and np.isclose(m.start.sum(), 1)
    for i, x in tok.items():
        symbols, inner = [], 0.0
        for w in x:
            k = lm.word_class(w)
            symbols.append(top.get(w, 1 + lm.SYMBOLS + k))
            inner += 0.0 if w in top else math.log10((c[w] + 1) / (n[k] + v[k] + 1))
        a = None
        for s in [*symbols, 0]:
            a = np.log(m.emit[s]) + (np.log(m.start) if a is None else np.logaddexp.reduce(a[:, None] + np.log(m.trans), axis=0))
        assert math.isclose(got[i], np.logaddexp.reduce(a) / math.log(10) + inner, rel_tol=1e-6)


def test_op7_tail_join(spark, monkeypatch):
    """With a tiny head table the counts of nearly all words come from the join."""
    want = {r.doc_id: r for r in queries.op7_lm_score(spark, SF).collect()}
    monkeypatch.setattr(lm, "HEAD", 5000)
    for r in queries.op7_lm_score(spark, SF).collect():
        assert r.n_known == want[r.doc_id].n_known and math.isclose(r.base_score, want[r.doc_id].base_score, rel_tol=1e-9)


def test_op7_start_counts_all_texts(spark, monkeypatch):
    """A long text, and one among many, has its say in the start."""
    monkeypatch.setattr(lm, "PASSES", 0)
    texts = [[1 + i % 9, 2, 0] for i in range(450)]
    fit = lambda more: lm.baum_welch(spark.createDataFrame([(i, t) for i, t in enumerate([*texts, more])], "doc_id long, symbols array<short>")).emit
    assert not np.allclose(fit([3] * 5000 + [0]), fit([4] * 5000 + [0]))
    cells = next(lm._pairs(iter([pa.RecordBatch.from_arrays([pa.array([[5, 6, 0], [0]], pa.list_(pa.int16()))], ["symbols"])])))
    wide = lm.OWN + lm.SHARED
    assert cells.to_pydict() == {"cell": [0, 5, 5 * wide + 6, 6 * wide], "n": [1, 1, 1, 1]}


def test_op7_forward_is_exact():
    import itertools

    r, s = np.random.default_rng(0), lm.STATES
    m = lm.Model.from_counts(r.random(s), r.random((s, s)), r.random((1 + lm.SYMBOLS + lm.CLASSES, s)))
    seqs = [np.array([1, 2, 3]), np.array([4]), np.array([2, 2, 7])]
    want = [math.log10(sum(m.start[p[0]] * m.emit[q[0], p[0]] * np.prod([m.trans[p[i - 1], p[i]] * m.emit[q[i], p[i]] for i in range(1, len(q))]) for p in itertools.product(range(s), repeat=len(q)))) for q in seqs]
    ll, start, trans, emit = m.forward(seqs, back=True)
    assert np.allclose(ll, want) and np.isclose(start.sum(), 3) and np.isclose(trans.sum(), 4) and np.isclose(emit.sum(), 7)


def test_op7_long_text():
    """Counts of a text worked through in segments equal those of the whole."""
    r, s = np.random.default_rng(1), lm.STATES
    m = lm.Model.from_counts(r.random(s), r.random((s, s)), r.random((1 + lm.SYMBOLS + lm.CLASSES, s)))
    for n in (1, 5, 20, 23):
        seq = r.integers(0, 4000, n)
        for got, want in zip(m.long_counts(seq, 5), m.forward([seq], back=True)[1:], strict=True):
            assert np.allclose(got, want)


def test_op2_gain(spark):
    """On held-out documents the classifier on posteriors beats the majority of the voters, and is near one on given labels."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    held = docs.join(labels, "doc_id").where(common.held_out("doc_id", 5, 0)).where("toxic is not null").select("text", "toxic").collect()
    y = np.array([r.toxic for r in held])
    texts = [(r.text or "").encode() for r in held]
    right = ((model.score(texts) >= 0.5) == y).mean()
    share = np.array([np.mean(toxicity.votes(t, model.lexicon)[0]) for t in texts])
    assert right >= 0.985 and right > ((share > np.quantile(share, 1 - y.mean())) == y).mean() + 0.01


def test_op8(spark, edge, none):
    import pyarrow as pa

    got = media.features(media.store(edge)).collect()
    assert len(got) == len(EDGE)
    for (_, t), r in zip(EDGE, got, strict=True):
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64) if raw else bytes(64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(p) + 44)
        t = pa.ipc.open_stream(r.tensors).read_all()
        assert t.schema.field("log_mel").type.shape == [media.FRAMES, media.MELS] and t.num_rows >= 1
        assert r.tensor_shape == [t.num_rows, media.FRAMES, media.MELS] and r.feature.endswith(hashlib.sha256(media.read_tensors(r.tensors).tobytes()).hexdigest())
        assert len(r.spans) >= 1 and all(0 <= s.start_s < s.end_s for s in r.spans)
    assert media.features(media.store(none)).count() == 0


def test_op8_tone_and_blocks(monkeypatch):
    a = media.Audio()
    n = np.arange(16000)
    x = (128 + 100 * np.sin(2 * np.pi * 1000 * n / 16000)).astype(np.uint8)
    y = a.resample(x, 0, a.length(len(x)))
    assert abs(np.argmax(np.abs(np.fft.rfft(y))[5:]) + 5 - 1000) <= 1
    whole = np.concatenate([p for p, _ in a.log_mel(x)])
    monkeypatch.setattr(media, "BLOCK", 7)
    assert np.allclose(whole, np.concatenate([p for p, _ in a.log_mel(x)]), atol=1e-4)
    quiet = np.r_[np.full(8000, 128, np.uint8), x, np.full(8000, 128, np.uint8)]
    spans = a.segments(np.concatenate([e for _, e in a.log_mel(quiet)]))
    assert len(spans) == 1 and abs(a.seconds(spans[0][0]) - 0.5) < 0.1


def test_op9(spark, edge, none):
    """A passage of 60 words in many documents, alone on a line and changed by one word: one keeps it."""
    r = random.Random(9)
    prose = lambda n: " ".join(r.choice(WORDS) + str(r.randrange(10**6)) for _ in range(n)) + "."
    passage = prose(60)
    near = passage.replace(passage.split()[30], "other")
    rows = [(i, f"{prose(40)}\n{passage if i % 3 else near}\n{prose(30)}") for i in range(30)] + [(100 + i, f"{prose(50)}\n{prose(30)}") for i in range(20)]
    got = {x.doc_id: x for x in substring.dedup(spark.createDataFrame(rows, "doc_id long, text string"), report=True).collect()}
    assert sum(passage in x.text or near in x.text for x in got.values()) <= 2 and (passage in got[0].text or near in got[0].text)
    for i, t in rows:
        if i >= 100:
            assert got[i].text == t
        else:
            assert t.split("\n")[0] in got[i].text and t.split("\n")[2] in got[i].text
    out = substring.dedup(edge)
    assert out.columns == edge.columns and out.count() == len(EDGE) and substring.dedup(none).count() == 0
    assert {x.doc_id: x.text for x in out.collect()}[1] is None


def test_repeated_ids(spark):
    """Rows of one id are separate: unique ones stay, whichever id they share; of full repeats one stays."""
    a, b = BASE[0], BASE[1]
    rows = [(3, a), (12, a), (12, b), (20, b + " tail"), (20, b + " tail"), (30, BASE[2]), (30, BASE[2]), (None, a), (5, None), (5, None)]
    docs = spark.createDataFrame([(i, t, "x", "y", 1, "t", 2) for i, t in rows], "doc_id long, text string, dup_id string, text_hash string, n long, component_id string, k int")
    got = minhash.dedup(docs)
    assert got.columns == docs.columns
    have = collections.Counter((r.doc_id, r.text) for r in got.collect())
    assert have == collections.Counter([(3, a), (12, b), (30, BASE[2]), (None, a), (5, None), (5, None)])


def test_sample_bound(spark):
    docs = spark.createDataFrame([(7, f"text {i}") for i in range(500)] + [(8, "x"), (None, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (8, 0), (None, 1)], "doc_id long, quality int")
    assert quality.labelled(docs, labels, "quality", 10).count() == 2
    assert quality.labelled(docs, labels, "quality", 1).count() == 1


def test_op1_near_group(spark):
    """Thousands of near copies of one document, each with an edit of its own: one group, no pairs within it."""
    r = random.Random(21)
    words = [r.choice(WORDS) + str(i) for i in range(200)]
    rows = [(i, " ".join([*words[: i % 190], f"e{i}", *words[i % 190 + 1 :]])) for i in range(1, 4000)] + [(0, " ".join(words))]
    got = {x.component_id for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0}


def test_op9_clashing_names(spark):
    rows = [(i, BASE[3] + ".", i, "g", 5) for i in range(4)] + [(None, BASE[3], 9, "g", 5), (9, None, 9, "g", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone_id long, _gone string, n_removed long")
    got = substring.dedup(docs)
    assert got.columns == docs.columns and {(r.doc_id, r.gone_id, r._gone, r.n_removed) for r in got.collect()} == {(i, x, "g", 5) for i, _, x, *_ in rows}
    assert {r.doc_id: r.text for r in got.collect()} == {0: BASE[3] + ".", 1: "", 2: "", 3: "", None: BASE[3], 9: None}


@pytest.mark.parametrize("kind", ["plain", "short lines", "code", "wide"])
def test_op9_recall_by_kind(kind):
    """A passage of 51 to 100 words in two texts shares a paragraph or gram, whatever its layout and script."""
    r, table, hit = random.Random(29), common.WordHashes(), 0

    def lay(n, w=None):
        w = w or ["".join(chr(0x4E00 + r.randrange(3000)) for _ in range(2)) if kind == "wide" else f"{r.choice(WORDS)}{r.randrange(9999)}" for _ in range(n)]
        if kind == "plain":
            return " ".join(w)
        if kind == "code":
            return "\n".join("    " * r.randrange(3) + " = ".join(w[i : i + 3]) + ";" for i in range(0, len(w), 3))
        return "\n".join(" ".join(w[i : i + 9]) for i in range(0, len(w), 9))

    for _ in range(300):
        p = lay(r.randrange(51, 101))
        join = " " if kind == "plain" else "\n"
        w, a, b = substring.units([join.join((lay(r.randrange(20, 200)), p, lay(r.randrange(20, 200)))).encode() for _ in range(2)], table)
        ga, _, gk = substring.grams(w)
        k = [{*substring.keys(w.h, a, b)[w.text_of(a) == i].tolist(), *gk[w.text_of(ga) == i].tolist()} for i in (0, 1)]
        hit += bool(k[0] & k[1])
    assert hit >= 0.98 * 300


def test_op9_against_all_pairs(spark):
    """Paragraphs on lines of their own: what stays is the first of each component of exact Jaccard, over all pairs."""
    r = random.Random(31)
    lines = []
    for _ in range(60):
        w = [f"{r.choice(WORDS)}{r.randrange(9999)}" for _ in range(r.randrange(25, 44))]
        for _ in range(r.randrange(1, 5)):
            v = list(w)
            for _ in range(r.randrange(3)):
                v[r.choice([0, 1, len(v) - 1])] = f"e{r.randrange(9999)}"
            lines.append(" ".join(v))
    r.shuffle(lines)
    rows = list(enumerate(lines))
    got = {x.doc_id: x for x in substring.dedup(spark.createDataFrame(rows, "doc_id long, text string"), report=True).collect()}
    heads = brute_components(rows, 80)
    whole = {i for i, x in got.items() if x.removed_words >= len(lines[i].split()) - 4}  # but for edges edited
    same = {i for i, x in got.items() if x.text == lines[i]}
    assert len(whole ^ {i for i, c in heads.items() if i != c}) <= 0.02 * len(rows) and same <= {i for i, c in heads.items() if i == c}


def test_op9_many_edits(spark):
    """Copies of one passage, each with another word changed: alike to the original, most not to each other."""
    r = random.Random(13)
    prose = lambda n: [f"{r.choice(WORDS)}{r.randrange(10**6)}" for _ in range(n)]
    lines = []
    for n in (60, 90):
        words = prose(n)
        lines.append(" ".join(words) + ".")
        for i in range(5, n - 5):
            lines.append(" ".join([*words[:i], f"new{i}", *words[i + 1 :]]) + ".")
    phrase = prose(30)  # 26 of 46 shingles, shared by many unlike paragraphs
    lines += [" ".join(phrase + prose(20)) + "." for _ in range(300)]
    lines += [x.rsplit(" ", 2)[0] + " end here." for x in lines[-20:]]
    r.shuffle(lines)
    rows = list(enumerate(lines))
    got = {x.doc_id: x.text for x in substring.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    heads = brute_components(rows, 80)
    assert {i for i, t in got.items() if t} == set(heads.values())


def test_exact_leaves_decided_pairs(spark):
    """A bucket's first hub has been compared with all others: a bucket of two gives no rows, one of three its other pair."""
    same = np.arange(1, 40, dtype=np.uint64).tobytes()
    sets = spark.createDataFrame([(k, same) for k in range(1, 6)], "k long, s binary")
    members = [(7, 1, 5), (7, 2, 4), (8, 3, 9), (8, 4, 2), (8, 5, 2)]
    members = spark.createDataFrame([(h, k, 39, d, k) for h, k, d in members], "h long, k long, n long, degree long, label long")
    assert [tuple(r) for r in minhash._exact(members, sets, 80).collect()] == [(4, 5)]


def test_exact_join_of_a_frequent_shingle_in_small_blocks():
    """All pairs of 1,000 sets with one shingle in common come in blocks of 131,072 at most."""
    n = 1000
    cols = [np.ones(n, np.int64), np.arange(n), np.arange(n), np.full(n, 39), np.zeros(n, np.int64)]
    got = [*minhash._cross(80)(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["t", "label", "k", "n", "i"])]))]
    assert max(b.num_rows for b in got) <= 1 << 17
    assert {(a, b) for x in got for a, b in zip(*(c.to_pylist() for c in x.columns), strict=True)} == {(a, b) for a in range(n) for b in range(a + 1, n)}


def test_batches_are_bounded_by_bytes(spark):
    """A map gets 600 texts of 100,000 bytes in batches of about BATCH bytes, whatever the limit of rows."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "size"])

    docs = spark.range(600, numPartitions=2).selectExpr("id", "repeat('a', 100000) text")
    got = common.arrow(docs, run, "rows long, size long").collect()
    assert sum(r.rows for r in got) == 600
    assert max(r.size for r in got) <= common.BATCH + 300_000


def test_op9_planted(spark):
    """Passages of 55 to 100 words in two documents, wrapped behind other short lines or inside text without sentence ends."""
    r = random.Random(17)
    prose = lambda n: [f"{r.choice(WORDS)}{r.randrange(10**6)}" for _ in range(n)]
    wrap = lambda w: "\n".join(" ".join(w[i : i + 12]) for i in range(0, len(w), 12))
    rows, passages = [], []
    for n in (55, 70, 100):
        for case in range(40):
            p = prose(n)
            passages.append(set(p))
            for _ in range(2):
                before, after = prose(r.randrange(30, 200)), prose(r.randrange(30, 200))
                rows.append((len(rows), "\n".join(map(wrap, (before, p, after))) if case % 2 else " ".join(before + p + after)))
    clean = [(1000 + i, wrap(prose(100))) for i in range(50)]
    got = {x.doc_id: x for x in substring.dedup(spark.createDataFrame(rows + clean, "doc_id long, text string"), report=True).collect()}
    assert all(got[i].text == t and got[i].n_removed == 0 for i, t in clean)
    caught = 0
    for i, p in enumerate(passages):
        first, second = (got[2 * i + j] for j in (0, 1))
        assert first.text == rows[2 * i][1]
        gone = set(rows[2 * i + 1][1].split()) - set(second.text.split())
        assert len(gone - p) <= 5  # of a paragraph alike that reaches over the edge
        assert second.removed_words == len(gone) and second.n_removed == len(second.removed_spans)
        caught += second.removed_words >= substring.RUN
    assert caught >= 0.98 * len(passages)


def test_pipeline(spark, none):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["quality classifier", "toxicity", "near-dedup", "substring dedup", "packing"]
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    label = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    seen = docs
    for name, stage in P.STAGES[:-1]:
        before = {r.doc_id: r.text for r in seen.select("doc_id", "text").collect()}
        seen = common.cut(stage(spark, seen, sf))
        after = {r.doc_id: r.text for r in seen.select("doc_id", "text").collect()}
        assert seen.columns == docs.columns and set(after) <= set(before)
        gone = [label[i] for i in set(before) - set(after) if i in label]
        if name == "quality classifier":
            assert sum(r.quality == 0 for r in gone) >= 0.9 * len(gone) > 0
        elif name == "toxicity":
            assert sum(r.toxic == 1 for r in gone) >= 0.9 * len(gone) > 0
        elif name == "near-dedup":
            assert set(after) == {i for i, c in brute_components([*before.items()], 80).items() if i == c}
    pieces = common.cut(P.STAGES[-1][1](spark, seen, sf))
    assert pieces.select("doc_id").distinct().count() == len(after)
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in P.STAGES:
        assert stage(spark, empty, sf).count() == 0
