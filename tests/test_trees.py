"""Depths, ways and subtree sums of dependency trees and graphs; lockfiles of yarn and Cargo."""

import random

from vigil.operators import advisories as A
from vigil.operators import trees as T
from vigil.sources import manifests as M

YARN = '''# yarn lockfile v1


"@babel/core@^7.0.0", "@babel/core@^7.1.0":
  version "7.1.2"
  resolved "https://x"
  dependencies:
    "@babel/parser" "^7.0.0"
    ms "2.0.0"

"@babel/parser@^7.0.0":
  version "7.0.1"

ms@2.0.0:
  version "2.0.0"
  optionalDependencies:
    loop "^1"

loop@^1:
  version "1.0.0"
  dependencies:
    ms "2.0.0"
'''


def test_lockfiles(spark):
    cargo = '[[package]]\nname = "a"\nversion = "1"\ndependencies = [\n "b 2",\n]\n\n[[package]]\nname = "b"\nversion = "2"\ndependencies = [\n "c",\n "b",\n]\n\n[[package]]\nname = "c"\nversion = "3"\n'
    files = spark.createDataFrame([("p/yarn.lock", YARN), ("q/yarn.lock", None), ("r/Cargo.lock", cargo), ("s/yarn.lock", YARN.replace("\n", "\r\n"))], "path string, content string")
    rows = {(r.path, r.name): (r.version, r.depth, r.parent, r.is_direct) for r in M.lock_tree(M.yarn_graph(files)).collect()}
    want = {"@babel/core": ("7.1.2", 0, None, True), "@babel/parser": ("7.0.1", 1, "@babel/core", False), "ms": ("2.0.0", 1, "@babel/core", False), "loop": ("1.0.0", 2, "ms", False)}
    assert rows == {(p, k): v for p in ("p/yarn.lock", "s/yarn.lock") for k, v in want.items()}
    assert {(r.name, r.depth, r.parent) for r in M.lock_tree(M.cargo_lock(files)).collect()} == {("a", 0, None), ("b", 1, "a"), ("c", 2, "b")}


def test_rollup(spark):
    r = random.Random(9)
    parent = {i: r.randrange(i) if i and r.random() < 0.95 else None for i in range(200)}
    bad = [(str(i), r.choice([*T.SEVERITIES, "High", None])) for i in (r.randrange(200) for _ in range(150))] + [("gone", "high")]
    tree = spark.createDataFrame([("f", str(i), None if p is None else str(p)) for i, p in parent.items()] + [("f", "0", None), ("f", "a", "b"), ("f", "b", "a"), ("f", "c", "a"), ("g", "0", "missing"), ("g", None, "0")], "path string, name string, parent string")
    got = {(x.path, x.name): x for x in T.rollup(tree, spark.createDataFrame([("f", *b) for b in bad], "path string, name string, severity string")).collect()}
    for i in range(200):
        way, k = [], i
        while k is not None:
            way.append(str(k))
            k = parent[k]
        below = {str(j) for j in range(200) if i in ancestors(parent, j)}
        x = got["f", str(i)]
        assert (x.depth, x.root, x.way) == (len(way) - 1, way[-1], way[::-1])
        assert x.own == sum(n == str(i) for n, _ in bad) and x.below == sum(n in below for n, _ in bad)
        assert x.below_high == sum(n in below and (s or "").lower() == "high" for n, s in bad)
    assert [(got["f", n].depth, got["f", n].below) for n in "abc"] == [(None, -1)] * 3
    assert got["g", "0"].way == ["0"] and len(got) == 204


def ancestors(parent, k):
    while k is not None:
        yield k
        k = parent[k]


def test_enrich(spark):
    tree = spark.createDataFrame([("f", "a", None), ("f", "b", "a"), ("f", "c", "b")], "path string, name string, parent string")
    found = spark.createDataFrame([("f", "c", "high", "CVE-1"), ("f", "a", "low", "CVE-2"), ("f", "z", "low", "CVE-3")], "path string, name string, severity string, cve string")
    got = {r.cve: tuple(r)[4:] for r in A.enrich(tree, found).collect()}
    assert got == {"CVE-1": (False, 2, ["a", "b", "c"], "b", "a"), "CVE-2": (True, 0, ["a"], None, "a"), "CVE-3": (True, 0, ["z"], None, "z")}


def test_nothing(spark):
    none = spark.createDataFrame([], "path string, name string, parent string, dependency string, severity string")
    assert T.depths(none, none).collect() == [] and T.rollup(none, none).collect() == []


def test_way_digests(spark):
    """Digests of the ways without the ways: bushy trees, chains, several roots and files, cycles."""
    import hashlib

    r = random.Random(4)
    rows = [("f", str(i), str(r.randrange(max(0, i - 4), i)) if i and r.random() < 0.97 else None) for i in range(120)] + [("g", str(i), str(i // 9) if i else None) for i in range(60)] + [("g", "a", "b"), ("g", "b", "a"), ("g", "c", "a")]
    tree = spark.createDataFrame(rows, "path string, name string, parent string")
    none = spark.createDataFrame([], "path string, name string, severity string")
    want = {(x.path, x.name): (x.way and hashlib.md5(">".join(x.way).encode()).hexdigest(), x.depth, x.root) for x in T.rollup(tree, none).collect()}
    got = {(x.path, x.name): (x.way_md5, x.depth, x.root) for x in T.rollup(tree, none, digest=True).collect()}
    assert got == want and len(got) == 183
    assert got["g", "c"] == (None, None, None)
