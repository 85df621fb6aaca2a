"""Quality rules, conversation repair and resampling against plain recomputation, on odd and on hot input."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tests.compare import norm, same
from tests.conftest import SF
from vigil.llm import conversations, queries, resampling, rules

NAMES = ["op11_quality_rules", "op12_conversation_repair", "op13_importance_resampling"]


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    same(queries.queries()[name](spark, SF), duck.sql(queries.oracle_sql()[name]))


# ---- conversation repair


def audits(turns):
    """Every (cost, audit, lines) of turns (fault, role, text), by trying all edits; inserted runs have two turns at most."""
    for inserts in itertools.product(range(3), repeat=len(turns) + 1):
        for edits in itertools.product("DKR", repeat=len(turns)):
            cost, audit, lines, roles = 0, "", [], ""
            for n, e, t in itertools.zip_longest(inserts, edits, turns):
                for _ in range(n):
                    lines.append(("I", ""))
                cost, audit = cost + 3 * n, audit + "I" * n
                if t is None:
                    continue
                fault, role, text = t
                if e != "D" and fault in ("blank", "duplicate"):
                    break
                audit += e
                cost += {"D": 4, "K": 0, "R": 3}[e] + 3 * (e != "D" and fault == "truncated")
                if e != "D":
                    lines.append((role if e == "K" else "I", text))
            else:
                out = []
                for k, (role, text) in enumerate(lines):
                    if role == "I":
                        role = "assistant" if roles[-1:] == "u" else "user"
                    roles += role[:1] or "?"
                    out.append(f"{role}:{text}")
                if re.fullmatch("(s?(ua)+)?", roles):
                    yield cost, audit, "\n".join(out)


def by_hand(rows):
    """(blank, duplicate, truncated, illegal, gaps, cost, audit, hash) of (turn, role, text) in order."""
    turns, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(" \t\n\r\x0b\x0c")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        turns.append((fault, role, text))
    faults = Counter(f for f, _, _ in turns)
    told = [t for t, _, _ in rows if t is not None]
    cost, audit, text = min(audits(turns))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    return (faults["blank"], faults["duplicate"], faults["truncated"], illegal, max(told) - min(told) + 1 - len(set(told)) if told else 0, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def conversations_of(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for k in range(rng.randrange(5)):
            rows.append((c if c else None, rng.choice([None, k, k, k, k + 3]), rng.choice(["user", "assistant", "system", "tool", "User", ""]), rng.choice(["Hi.", "Yes!", "no end", " ", "", "Hi.", "ends? \n"]), rng.choice([1, 1, 1, 2, 0])))
    return rows


def order(rows):
    digest = lambda r: hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, digest(r)))


@pytest.mark.parametrize("most", [(conversations.ROWS, conversations.BYTES), (2, 1 << 20), (100, 8)])
def test_repair_by_trying_all(spark, most):
    rows = conversations_of(7, 25)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies int")
    got = {r.conv_id: r for r in conversations.repair(df, *most).collect()}
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        mine = [x[1:4] for x in order([x for x in rows if x[0] == c]) for _ in range(x[4])]
        assert (r.blank, r.duplicate, r.truncated, r.illegal, r.gaps, r.cost, r.audit, r.repaired_sha256) == by_hand(mine), (c, mine)


def test_repair_one_long_conversation(spark):
    """One conversation of nearly all rows, in many partitions and blocks, as in one block; equal rows too."""
    rng = random.Random(3)
    rows = [(5, i // 2, rng.choice(["user", "assistant", "system"]), rng.choice([f"t {i}.", f"t {i}", "again.", " "]), 1) for i in range(3000)] + [(6, 0, "user", "x.", 1)] + [(5, None, "user", "same.", 1)] * 1500
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies int").repartition(6)
    parts, one = ({r.conv_id: r for r in conversations.repair(d, *m).collect()} for d, m in ((df, (64, 1 << 20)), (df.coalesce(1), (1 << 20, 1 << 30))))
    assert parts == one and len(parts) == 2 and len(parts[5].audit) >= 4500
    block = conversations.Block()
    for _, t, role, text, n in order([r for r in rows if r[0] == 5]):
        block.add((t, f"{len(role)}:{role}{text}".encode(), role.encode(), text.encode(), n))
    w = conversations.whole(block)
    assert all(parts[5][k] == v for k, v in w.items())


def test_repair_edges(spark, tmp_path):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair(conversations.damage(empty)).collect() == []
    crc = lambda c, t: zlib.crc32(f"{c}:{t}".encode()) % 20
    gone = next(c for c in range(1000) if crc(c, 0) == 0)
    twice = next(c for c in range(1000) if crc(c, 0) == 3)
    big = "word " * 300_000
    rows = [(gone, 0, "user", "a."), (twice, 0, None, None), (None, None, "user", big), (None, 4, "assistant", big + ".")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, digest int, copies string")
    got = {r.conv_id: r for r in conversations.repair(conversations.damage(df)).collect()}
    assert set(got) == {gone, twice, None}
    assert norm(got[gone][1:]) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert (got[twice].blank, got[twice].audit, got[twice].cost) == (2, "DD", 8)


# ---- resampling


def drawn(docs, target):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    feats = lambda t: [zlib.crc32(b" ".join(ws[i : i + n])) % 10000 for ws in [words(t)] for n in (1, 2, 3) for i in range(len(ws) - n + 1)]
    s, t = Counter(f for _, x in docs for f in feats(x)), Counter(f for x in target for f in feats(x))
    S, T = sum(s.values()), sum(t.values())
    out = []
    for i, x in docs:
        f = feats(x)
        w = sum(math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in f)
        out.append([i, len(f), w, w + resampling.noise(i), None, len(words(x)) >= 20])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def test_resampling_by_hand(spark):
    rng = random.Random(1)
    docs = [(i if i % 50 else None, " ".join(rng.choice("alpha beta Gamma delta é0 x-y end.".split()) for _ in range(rng.randrange(60)))) for i in range(600)]
    docs += [(7, "one two three four five " * 5)] * 400 + [(9, None), (10, ""), (11, "w " * 1_000)]
    target = ["alpha beta gamma", "beta gamma delta", None]
    d = spark.createDataFrame([(*r, "c", 3) for r in docs], "doc_id long, text string, bucket string, rank int").repartition(7)
    t = spark.createDataFrame([(x,) for x in target], "text string")
    want = drawn(docs, target)
    weighed = resampling.weigh(d, resampling.gains(resampling.counts(d), resampling.counts(t)))
    for samples, rows in ((resampling.SAMPLES, resampling.RANGE), (10_000, 3), (20, 1)):
        got = resampling.draw(weighed, samples=samples, rows=rows).collect()
        assert sorted((tuple(r) for r in got), key=repr) == want
    assert resampling.resample(d.limit(0), t).collect() == []
    assert resampling.resample(d, t.limit(0)).count() == len(docs)


def test_features_in_parts(monkeypatch):
    text = " ".join(f"w{i}" for i in range(25)).encode()
    whole = sorted(x for f in resampling.features(text) for x in f.tolist())
    for n in (1, 2, 3, 7, 24, 25):
        monkeypatch.setattr(resampling, "CHUNK", n)
        assert sorted(x for f in resampling.features(text) for x in f.tolist()) == whole


def test_tournament():
    rng = random.Random(0)
    for k in range(8):
        runs = [sorted((rng.randrange(9), i, j) for j in range(rng.randrange(6))) for i in range(k)]
        assert [*resampling.tournament(runs)] == sorted(x for r in runs for x in r)


# ---- quality rules


def test_rules_by_hand(spark):
    rng = random.Random(2)
    common = "the of and to a in is it was for".split()
    prose = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("abcdeilnorst") for _ in range(6)) for _ in range(n)) + "."
    docs = [(i, "en", prose(rng.randrange(120, 200))) for i in range(60)] + [(100 + i, "en", "the same copy of words " + "qq xx zz yy kk jj vv ww pp mm " * 2 + prose(100)) for i in range(20)]
    odd = [(200, "en", None), (201, "en", ""), (202, "en", "too short"), (203, "en", " ".join(["#$%&"] * 200)), (204, None, prose(150)), (205, "xx", " ".join(f"w{i}" for i in range(60))), (206, "en", "one two three four five six seven eight nine ten " * 30),
           (207, "en", "ABC DEF | " * 3 + " ".join(f"Q{i}|" for i in range(100))), (208, "en", "a b\n\na b\n \n a b\na b\n" + prose(30)), (None, "en", prose(90)), (209, "en", prose(200_000)), (210, "en", "é ü# " * 3)]
    docs += odd + [odd[3]] * 2
    df = spark.createDataFrame([(*r, "c", 1) for r in docs], "doc_id long, lang string, text string, words string, n_words int").repartition(5)
    got = rules.judge(df, rules.references(df)).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    for i, _, text in docs:
        t = text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = Counter(tuple(ws[k : k + 8]) for k in range(len(ws) - 7))
        covered = {k + j for k in range(len(ws) - 7) if grams[tuple(ws[k : k + 8])] > 1 for j in range(8)}
        r = by[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(ws) < 20 or 100 * len(covered) > 30 * len(ws)) and not (r.base_failed and r.kept)
    assert all(by[i].kept for i in range(60)) and by[209].kept and by[204].kept and by[205].kept
    assert by[205].class_distance is None  # no reference for its language
    assert not by[203].kept and not by[207].kept and not by[206].kept
    assert by[208].n_dup_lines == 2
    assert rules.judge(df.limit(0), rules.references(df.limit(0))).collect() == []


def test_rules_keep_good_and_find_junk(spark):
    sf = "/root/testdata/sf0.01"
    j = queries.op11_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("n_words >= 20").selectExpr("quality", "cast(kept as int) k").groupBy("quality").avg("k").collect()
    share = {r.quality: r[1] for r in j}
    assert share[1] >= 0.98 and share[0] <= 0.1
