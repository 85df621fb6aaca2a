"""Literal factors of patterns, and scans by factors against trying every pattern on every line."""

import random

import pytest

from vigil.operators import prefilter as P
from vigil.operators import textscan as T
from vigil.operators.textscan import Rule


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        ("password", {"password"}), (r"passw(or)?d\s*=", {"passw"}), ("select|insert", {"select", "insert"}), ("select|.", None), ("(evaluate|run)x", {"evaluate", "run"}), ("a?bcd+e", None), ("(?i)SECRET", {"secret"}), ("(abc){2,}", {"abc"}), ("(abc)*", None),
        ("[[a]bcd]", None), (r"\[abc\]", {"[abc]"}), (r"[\[]abc", {"[abc"}), ("(?x)a b c", None), ("(?iu)kelvin", None), (r"\p{L}abc", None), (r"foo\vlonger", {"longer"}), ("foo(?!barred)", {"foo"}), ("", None), ("(", None), ("Äpfel", {"Äpfel"}),
    ],
)
def test_factors(pattern, want):
    assert P.factors(pattern) == (None if want is None else frozenset(want))


def _pattern(r, depth=0):
    word = "".join(r.choice("abcAB") for _ in range(r.randint(1, 4)))
    inner = lambda: _pattern(r, depth + 1)
    forms = [
        lambda: word, lambda: word, lambda: f"[{word}]", lambda: f"({inner()}|{inner()})", lambda: f"{word}({inner()})?", lambda: f"(?:{inner()}){{1,2}}", lambda: f"{inner()}.*{inner()}", lambda: f"{word}(?!{inner()})",
        lambda: f"{inner()}{inner()}",
    ]
    return forms[r.randrange(9 if depth < 2 else 3)]()


def test_five_hundred_rules(spark):
    r = random.Random(4)
    rules = [Rule(f"r{i}", _pattern(r), r.choice(["low", "high"]), r.choice(["*", "py", "go"]), r.choice("xy"), r.random() < 0.5) for i in range(500)]
    texts = [(i, r.choice(["py", "go", None]), "\n".join("".join(r.choice("abcABC \r") for _ in range(r.randrange(12))) for _ in range(r.randrange(8)))) for i in range(60)] + [(98, "py", None), (99, None, "abcä\nABCİ\n")]
    df = spark.createDataFrame(texts, "id long, lang string, t string")
    got = sorted(map(tuple, P.scan(df, "id", "t", rules, "lang").collect()))
    language = T.F.col("lang")
    lined = T.lines(df.select("id", "t"), "id", "t").join(df.select("id", "lang"), "id")
    want = sorted((x.id, x.line_number, x.line, x.rule_id, x.severity, x.category) for x in T.scan(lined, rules, language).collect())
    assert got == want and len(got) > 1000


def test_lines_without_a_factor_are_not_tried(spark):
    df = spark.createDataFrame([(1, "x\nthe PassWord = 1\ny\nsecret\n" + "plain\n" * 50 + "sec ret")], "id long, t string")
    rules = [Rule("a", "password", ignore_case=True), Rule("b", "secret|hidden"), Rule("c", "PASSWORD", ignore_case=False)]
    assert [(x.line_number, x["_try"]) for x in P.in_question(df, "id", "t", rules).collect()] == [(2, [0, 2]), (4, [1])]
    assert [(x.line_number, x.rule_id) for x in P.scan(df, "id", "t", rules).collect()] == [(2, "a"), (4, "b")]
    assert P.in_question(df, "id", "t", [*rules, Rule("d", "[xy]")]).count() == 55
    assert "Exchange" not in P.scan(df, "id", "t", rules)._jdf.queryExecution().executedPlan().toString()


def test_nothing(spark):
    df = spark.createDataFrame([], "id long, t string")
    assert P.scan(df, "id", "t", [Rule("a", "abc")]).collect() == [] and P.scan(spark.createDataFrame([(1, "a")], "id long, t string"), "id", "t", []).collect() == []


def test_lines_leave_in_small_batches():
    import pyarrow as pa

    b = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(["some token here\nx\n"] * 99 + [None])], ["id", "_t"])
    out = [*P._search([Rule("a", "token")], 1000)(iter([b]))]
    assert max(o.num_rows for o in out) < 20 and sum(o.num_rows for o in out) == 99
    assert out[0].slice(0, 1).to_pylist() == [{"id": 0, "line_number": 1, "line": "some token here", "_try": [0]}]
