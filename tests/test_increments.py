"""Threat models kept up to date against a plain recomputation; changes, impact and states by hand."""

import random

import pytest

from vigil.operators import increments as I

C = "id long, category string, internet_facing boolean, sensitive boolean, trust_level string, encryption string"
FL = "source long, target long, category string, protocol string"
K = "category string, stride string, threat string, severity string"
CATALOG = [("api", "Spoofing", "forged identity", "high"), ("api", "Tampering", "changed request", "medium"), ("db", "Information Disclosure", "leaked rows", "critical"), ("link", "Tampering", "changed on the way", "high"), ("link", None, "read on the way", "odd")]


def _random(r):
    comps = {i: (i, r.choice(["api", "db", "other"]), r.choice([True, False, None]), r.choice([True, None]), r.choice(["untrusted", "internal", None]), r.choice(["on", None])) for i in r.sample(range(40), 25)}
    flows = {(a, b): (a, b, r.choice(["link", "none"]), r.choice(["tls", None])) for a, b in ((r.choice([*comps]), r.choice([*comps])) for _ in range(40))}
    return comps, flows


def _edit(r, comps, flows):
    other, links = _random(r)
    comps = {**{k: v for k, v in comps.items() if r.random() > 0.25}, **{k: v for k, v in other.items() if r.random() < 0.15}}
    comps = {k: (*v[:2], not v[2], *v[3:]) if r.random() < 0.3 else v for k, v in comps.items()}
    flows = {**{k: v for k, v in flows.items() if r.random() > 0.1}, **{k: v for k, v in links.items() if r.random() < 0.1}}
    return comps, flows


def _frames(spark, snap):
    return spark.createDataFrame([*snap[0].values()], C), spark.createDataFrame([*snap[1].values()], FL)


def _removed(a, b):
    return {str(k) for k in a[0].keys() - b[0].keys()}


def _content(x):
    return (x.severity, x.risk_score)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_edits(spark, seed):
    r = random.Random(seed)
    catalog = spark.createDataFrame(CATALOG, K)
    snap = _random(r)
    nothing = spark.createDataFrame([], C), spark.createDataFrame([], FL)
    life = I.update(nothing, _frames(spark, snap), catalog, I.derive(*nothing, catalog))
    rows = life.collect()
    assert {x.status for x in rows} == {"new"} and {x.threat_id for x in rows} == {x.threat_id for x in I.derive(*_frames(spark, snap), catalog).collect()}
    model, seen = {x.threat_id: x for x in rows}, set()
    for _ in range(2):
        after = _edit(r, *snap)
        kept = spark.createDataFrame([tuple(x)[:6] for x in model.values()], "threat_id string, stride string, threat string, severity string, risk_score double, components array<string>")
        got = {x.threat_id: x for x in I.update(_frames(spark, snap), _frames(spark, after), catalog, kept).collect()}
        full = {x.threat_id: x for x in I.derive(*_frames(spark, after), catalog).collect()}
        gone = _removed(snap, after)
        want = {}
        for k in model.keys() | full.keys():
            if k not in model:
                want[k] = ("new", _content(full[k]))
            elif k in full:
                same = _content(full[k]) == _content(model[k])
                want[k] = ("existing" if same else "modified", _content(full[k]))
            else:
                want[k] = ("resolved" if gone & {*model[k].components} else "existing", _content(model[k]))
        assert {k: (x.status, _content(x)) for k, x in got.items()} == want
        assert all((x.previous is not None) == (x.status == "modified") for x in got.values())
        seen |= {x[0] for x in want.values()}
        model = {k: x for k, x in got.items() if x.status != "resolved"}
        snap = after
    assert seen == {"new", "existing", "modified", "resolved"}


def test_only_what_is_touched_is_derived(spark):
    comps = {i: (i, "api", None, None, None, None) for i in range(6)}
    flows = {(i, i + 1): (i, i + 1, "link", None) for i in range(5)}
    new = {**comps, 0: (0, "api", True, None, None, None)}
    a, b = _frames(spark, (comps, flows)), _frames(spark, (new, flows))
    ids = I.affected(I.changes(a[0], b[0], ["id"]), I.changes(a[1], b[1], ["source", "target"]))
    c, f = I.touched(*b, ids)
    assert [x.id for x in c.collect()] == [0] and [(x.source, x.target) for x in f.collect()] == [(0, 1)]


def test_changes_impact_states(spark):
    old = spark.createDataFrame([(1, "on", 1), (2, "on", 1), (3, None, 1), (None, "x", 1)], "id long, encryption string, n int")
    new = spark.createDataFrame([(1, "off", 2), (3, None, 1), (4, "on", 1), (4, "on", 1)], "id long, encryption string, n int")
    d = I.changes(old, new, ["id"])
    assert sorted((x.id, x.status, x.changed) for x in d.collect()) == [(1, "modified", ["encryption", "n"]), (2, "removed", []), (4, "added", [])]
    none = spark.createDataFrame([], "source long, target long, status string, changed array<string>")
    assert tuple(I.impact(d, none, none).first()) == (3, 0.53, True) and tuple(I.impact(none, none, none).first()) == (0, 0.0, False)
    flows = spark.createDataFrame([(3, 9, "modified", ["n"])], none.schema)
    assert tuple(I.impact(none, flows, none).first()) == (1, 0.06, False)
    ids = I.affected(d, flows)
    assert sorted(map(tuple, ids.collect())) == [(1, False), (2, True), (3, False), (4, False), (9, False)]
    t = spark.createDataFrame([("a", ["1", "2"]), ("b", ["3"]), ("c", ["7"]), ("d", None)], "threat_id string, components array<string>")
    assert {x.threat_id: x.state for x in I.touched_threats(t, ids).collect()} == {"a": "orphaned", "b": "affected", "c": "unaffected", "d": "unaffected"}


def test_a_field_only_one_snapshot_has(spark):
    old, new = spark.createDataFrame([(1, "x")], "id long, a string"), spark.createDataFrame([(1, "x", "y")], "id long, a string, b string")
    assert [tuple(x) for x in I.changes(old, new, ["id"]).collect()] == [(1, "modified", ["b"])]


def test_different_threats_with_one_id(spark):
    """Hashes of eight digits meet: the states of the threats stay apart, and in the lifecycle each old one meets each new one."""
    cols = "threat_id string, stride string, threat string, severity string, risk_score double, components array<string>"
    old = spark.createDataFrame([("a", "S", "x", "high", 7.5, ["1"]), ("a", "S", "y", "low", 2.5, ["2"]), ("b", "S", "x", "low", 2.5, ["2"]), ("b", "S", "z", "low", 2.5, ["4"])], cols)
    derived = spark.createDataFrame([("a", "S", "x", "high", 8.5, ["1"])], cols)
    ids = spark.createDataFrame([(1, False), (4, True)], "id long, removed boolean")
    assert sorted((x.threat_id, x.threat, x.state) for x in I.touched_threats(old, ids).collect()) == [("a", "x", "affected"), ("a", "y", "unaffected"), ("b", "x", "unaffected"), ("b", "z", "orphaned")]
    got = [(x.threat_id, x.status, x.risk_score, x.previous and x.previous.risk_score) for x in I.classify(old, derived, ids).collect()]
    assert sorted(got, key=repr) == sorted([("a", "modified", 8.5, 7.5), ("a", "modified", 2.5, 7.5), ("a", "modified", 8.5, 2.5), ("a", "existing", 2.5, None), ("b", "existing", 2.5, None), ("b", "existing", 2.5, None)], key=repr)
