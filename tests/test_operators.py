"""Operators on small fixtures: sources, versions, dataflow, reachability, streaming."""

import json

from pyspark.sql import functions as F

from vigil.functions import secrets as X
from vigil.functions import versions as V
from vigil.operators import advisories as A
from vigil.operators import relational as R
from vigil.operators import taint as T
from vigil.operators import textscan as S
from vigil.sources import files as Fi
from vigil.sources import intel as I
from vigil.sources import manifests as M
from vigil.streaming import commits as St

FILES = [
    ("a/package.json", json.dumps({"dependencies": {"lodash": "^4.17.19"}, "devDependencies": {"jest": "~29.0.0"}})),
    ("a/package-lock.json", json.dumps({"packages": {"": {}, "node_modules/lodash": {"version": "4.17.19"}, "node_modules/a/node_modules/b": {"version": "1.0.0", "dev": True}}})),
    ("a/yarn.lock", '# yarn\n\n"@babel/core@^7.0.0":\n  version "7.1.0"\n\nlodash@^4.0.0:\n  version "4.17.20"\n'),
    ("b/requirements.txt", "# c\nflask==2.0.1\nrequests[socks]>=2.25\n-r other.txt\nnumpy\n"),
    ("b/Pipfile.lock", json.dumps({"default": {"six": {"version": "==1.16.0"}}, "develop": {"pytest": {"version": "==7.0"}}})),
    ("c/pom.xml", "<project><properties><v.x>1.2.3</v.x></properties><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>${v.x}</version></dependency><dependency><groupId>h</groupId><artifactId>b</artifactId><version>2</version><scope>test</scope></dependency></dependencies></project>"),
    ("c/build.gradle", "dependencies {\n implementation 'g:a:1.0'\n testImplementation(\"g:t:2.0\")\n}"),
    ("d/composer.json", json.dumps({"require": {"php": ">=8", "x/y": "^1.2"}, "require-dev": {"z/w": "2.0"}})),
    ("d/composer.lock", json.dumps({"packages": [{"name": "x/y", "version": "v1.2.3"}], "packages-dev": []})),
    ("e/Gemfile.lock", "GEM\n  specs:\n    rails (6.1.0)\n      actionpack (= 6.1.0)\n"),
    ("f/go.mod", "module m\n\nrequire (\n\tgithub.com/a/b v1.2.3\n)\n"),
    ("f/go.sum", "github.com/a/b v1.2.3 h1:x=\ngithub.com/a/b v1.2.3/go.mod h1:y=\n"),
    ("g/Cargo.toml", '[package]\nname = "p"\n[dependencies]\nserde = "1.0"\ntokio = { version = "1.2", features = ["x"] }\n[dev-dependencies]\nrand = "0.8"\n'),
    ("h/x.csproj", '<ItemGroup><PackageReference Include="N.J" Version="13.0.1" /></ItemGroup>'),
    ("i/vcpkg.json", json.dumps({"dependencies": ["zlib", {"name": "fmt", "version>=": "9.0"}]})),
    ("j/conanfile.txt", "[requires]\nzlib/1.2.11\n[generators]\ncmake\n"),
    ("k/readme.md", "nothing"),
    ("l/package.json", "not json"),
]


def test_manifests(spark):
    got = {(r.path[0], r.name, r.version, r.dev) for r in M.parse(spark.createDataFrame(FILES, "path string, content string")).collect()}
    assert got == {
        ("a", "lodash", "4.17.19", False), ("a", "jest", "29.0.0", True), ("a", "b", "1.0.0", True), ("a", "@babel/core", "7.1.0", False), ("a", "lodash", "4.17.20", False),
        ("b", "flask", "2.0.1", False), ("b", "requests", "2.25", False), ("b", "numpy", "", False), ("b", "six", "1.16.0", False), ("b", "pytest", "7.0", True),
        ("c", "g:a", "1.2.3", False), ("c", "h:b", "2", True), ("c", "g:a", "1.0", False), ("c", "g:t", "2.0", True), ("d", "x/y", "1.2", False), ("d", "z/w", "2.0", True), ("d", "x/y", "1.2.3", False),
        ("e", "rails", "6.1.0", False), ("f", "github.com/a/b", "1.2.3", False), ("g", "serde", "1.0", False), ("g", "tokio", "1.2", False), ("g", "rand", "0.8", True), ("h", "N.J", "13.0.1", False),
        ("i", "zlib", None, False), ("i", "fmt", "9.0", False), ("j", "zlib", "1.2.11", False),
    }


def test_trees(spark):
    tree = M.npm_tree(spark.createDataFrame(FILES, "path string, content string"))
    assert {(r.name, r.depth, r.parent, r.is_direct) for r in tree.collect()} == {("lodash", 0, None, True), ("b", 1, "a", False)}
    s = A.transitive_summary(tree).first()
    assert (s.total, s.direct, s.transitive, s.packages, s.max_depth) == (2, 1, 1, 2, 1)
    pip = M.indented_tree(spark.createDataFrame([("t/tree.txt", "flask==2.0\n  jinja2==3.0\n    markupsafe==2.0\n  click==8.0\n")], "path string, content string"), "tree.txt", r"([A-Za-z0-9]+)==(\S+)", 2)
    assert {(r.name, r.depth, r.parent) for r in pip.collect()} == {("flask", 0, None), ("jinja2", 1, "flask"), ("markupsafe", 2, "jinja2"), ("click", 1, "flask")}
    assert {r.path for r in A.dependency_paths(pip).collect()} >= {"flask > jinja2 > markupsafe", "flask > click"}


def test_versions(spark):
    rows = [("1.10.0", ">=1.9,<2", True), ("1.9.0", ">1.9.0", False), ("2.0.0-rc1", "<2.0.0", True), ("v1.2", "=1.2.0", True), ("1.2.3", "!=1.2.3", False), ("x", ">=1", None)]
    df = spark.createDataFrame(rows, "v string, c string, w boolean").withColumn("got", V.satisfies(F.col("v"), F.col("c")))
    assert [r.got for r in df.collect()] == [r[2] for r in rows]
    adv = spark.createDataFrame([("lodash", "npm", 2, ["<4.17.21"]), ("Lodash", "npm", 1, ["<4.17.20", ">=5"])], "package string, ecosystem string, ordinal int, versions array<string>")
    dep = spark.createDataFrame([("npm", "lodash", "4.17.19"), ("npm", "lodash", "4.17.20")], "ecosystem string, name string, version string")
    assert {(r.version, r.ordinal) for r in A.matches(dep, adv).collect()} == {("4.17.19", 1), ("4.17.20", 2)}
    assert A.matches(dep, adv, first_only=False).count() == 3


def test_reachability(spark):
    files = [("x.js", "const _ = require('lodash');\napp.get('/', (req) => _.merge({}, req.body));"), ("y.js", "import axios from 'axios'\nlet a = 1"), ("z.js", "const jwt = require('jsonwebtoken');\njwt.verify(t)")]
    dep = [("lodash", "4"), ("axios", "0"), ("minimist", "1"), ("jsonwebtoken", "8")]
    fn = [("lodash", "merge"), ("axios", "get"), ("jsonwebtoken", "verify")]
    got = T.reachability(spark.createDataFrame(dep, "package string, version string"), spark.createDataFrame(files, "path string, content string"), spark.createDataFrame(fn, "package string, function string"))
    assert {r.package: r.exploitability for r in got.collect()} == {"lodash": "exploitable", "axios": "imported_only", "minimist": "not_reachable", "jsonwebtoken": "potentially_exploitable"}


def test_taint_labels():
    count = lambda code: len([*T.flows_of(code)])
    assert count("q = request.args.get('q')\ncursor.execute('SELECT ' + q)") == 1
    assert count("a = request.args['a']\nb = a\nc = b.strip()\nos.system(c)") == 1
    assert count("a = request.args['a']\nb = shlex.quote(a)\nos.system(b)") == 0
    assert count("# os.system(request.args['a'])") == 0
    assert count("") == 0


def test_rules_and_masks(spark):
    good, bad = S.valid_rules(spark, [S.Rule("a", "x+"), S.Rule("b", "(")])
    assert [r.id for r in good] == ["a"] and [r.id for r, _ in bad] == ["b"]
    df = spark.createDataFrame([("abc",), ("abcdefghij",), ("abcdefghijklmnopqrst",), ("",)], "s string")
    assert [r.m for r in df.select(X.mask(F.col("s")).alias("m")).collect()] == ["***", "ab******ij", "abcd************qrst", ""]
    assert [round(r.e, 3) for r in df.select(X.entropy(F.col("s")).alias("e")).collect()] == [1.585, 3.322, 4.322, 0.0]


def test_source_tree(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    for name, text in (("a.py", "x"), ("b.bin", "x"), ("node_modules/c.js", "x"), ("big.js", "y" * 50)):
        (tmp_path / name).write_text(text)
    files, skipped = Fi.source_tree(spark, str(tmp_path), max_bytes=40)
    assert [(r.path.rsplit("/", 1)[1], r.language, r.content) for r in files.collect()] == [("a.py", "python", "x")]
    assert {r.reason for r in skipped.collect()} == {"vendor folder", "extension", "too large"}


def test_intel(spark):
    raw = spark.createDataFrame([("T1", "HIGH", "a; b"), ("T2", "odd", None), (None, "low", "")], "`Threat Name` string, Risk string, Labels string")
    assert [(r.title, r.severity, r.tags) for r in I.normalise(raw).orderBy("title").collect()] == [("T1", "high", ["a", "b"]), ("T2", "medium", [])]
    bundle = {"objects": [{"type": "indicator", "id": "i", "name": "n", "pattern": "[ipv4-addr:value = '1.2.3.4' OR url:value = 'http://x.y/z']", "confidence": 90}, {"type": "attack-pattern", "id": "t", "name": "m", "external_references": [{"source_name": "mitre-attack", "external_id": "T1059"}]}, {"type": "marking", "id": "q"}]}
    o = I.stix(spark.createDataFrame([(json.dumps(bundle),)], "content string"))
    assert {(r.id, r.kind, r.severity, tuple(r.mitre)) for r in o.collect()} == {("i", "indicator", "critical", ()), ("t", "technique", "medium", ("T1059",))}
    assert {(r.ioc_type, r.ioc_value) for r in I.indicators(o).collect()} == {("ip", "1.2.3.4"), ("url", "http://x.y/z")}
    good, bad = I.controls(spark.createDataFrame([("c", "1.7", "Spoofing"), ("d", None, ""), ("e", "x", ""), ("f", "0.5", "nope")], "name string, effectiveness string, stride string"))
    assert {(r.name, r.effectiveness) for r in good.collect()} == {("c", 1.0), ("d", 0.7)}
    assert {(r.name, r.reason) for r in bad.collect()} == {("e", "effectiveness is no number"), ("f", "unknown category")}


def test_upserts(spark):
    a = spark.createDataFrame([(1, "x", 1)], "k int, v string, o int")
    b = spark.createDataFrame([(1, "y", 2), (2, "z", 1), (2, "w", 3)], "k int, v string, o int")
    assert {(r.k, r.v) for r in R.upsert(a, b, ["k"], [F.col("o").desc()]).collect()} == {(1, "y"), (2, "w")}
    assert {(r.k, r.v) for r in R.insert_ignore(a, b, ["k"], ["o"]).collect()} == {(2, "z")}


def test_streaming_twins(spark, tmp_path):
    """The stream finds the anomalies that the batch operator finds."""
    from vigil.operators import timeline

    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("user_id < 5").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = St.detect(stream).writeStream.format("memory").queryName("found").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    batch = timeline.anomalies(timeline.rolling(rows, "user_id", ["ts", "event_id"], "value"), "value")
    want = {(r.event_id, r.severity) for r in batch.collect()}
    assert {(r.event_id, r.severity) for r in spark.sql("select * from found").collect()} == want
    q = St.daily(St.fresh(stream, ["event_id"], "ts"), "ts", "event_type", late=None).writeStream.format("memory").queryName("days").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "d")).start()
    q.awaitTermination()
    assert spark.sql("select sum(count) s from days").first().s <= rows.count()


def test_commit_signals(spark):
    from vigil.operators import commit_signals as G

    df = spark.createDataFrame([("config/.env", "update", 80, "2024-01-01T03:00:00+05:00"), ("a/b.PY", "a good message", 80, "2024-01-01T20:59:00Z"), ("x.tar.gz", "", 90, None), ("id_rsa", "wip", 10, "bad")], "path string, message string, n int, at string")
    got = df.select(G.sensitive_pattern(F.col("path")).alias("s"), G.binary_extension(F.col("path")).alias("b"), G.message_signal(F.col("message"), F.col("n")).alias("m"), G.off_hours(F.col("at")).alias("o")).collect()
    assert [tuple(r) for r in got] == [(r"\.env$", None, "vague", True), (None, None, None, False), (None, ".tar.gz", "empty", False), ("id_rsa", None, None, False)]
    diff = "+++ b/package.json\n+ \"postinstall\": \"x\"\n- old\n+++ b/app/settings.py\n+DEBUG = True\n+verify_ssl = False\n"
    c = spark.createDataFrame([(1, diff)], "sha int, diff string")
    assert [r.label for r in G.labelled_lines(c, "sha", "diff", G.DEPENDENCY_TAMPERING, r"package\.json$").collect()] == ["install_script"]
    assert {r.label for r in G.labelled_lines(c, "sha", "diff", G.CONFIG_WEAKENING, ignore_case=False).collect()} == {"debug_enabled", "ssl_verify_disabled"}
    s = spark.createDataFrame([(1, "sensitive_file")] * 3 + [(1, "critical"), (2, "unsigned"), (3, "off_hours"), (3, "off_hours")], "sha int, signal string")
    assert {(r.sha, r.score, r.level) for r in G.score(s, "sha").collect()} == {(1, 5.5, "high"), (2, 0.5, "low"), (3, 1.0, "low")}


def test_nested_trees_and_exports(spark):
    from vigil.sources import exports as E

    old = json.dumps({"dependencies": {"a": {"version": "1", "dependencies": {"b": {"version": "2", "dependencies": {"c": {"version": "3"}}}}}, "d": {"version": "4"}}})
    lock = '[[package]]\nname = "x"\nversion = "1.0"\ndependencies = [\n "y 0.1",\n "z",\n]\n\n[[package]]\nname = "y"\nversion = "0.1"\n'
    files = spark.createDataFrame([("p/package-lock.json", old), ("q/package-lock.json", "{"), ("r/Cargo.lock", lock)], "path string, content string")
    assert {(r.name, r.version, r.depth, r.parent) for r in M.npm_v1_tree(files).collect()} == {("a", "1", 0, None), ("b", "2", 1, "a"), ("c", "3", 2, "b"), ("d", "4", 0, None)}
    assert {(r.name, r.version, tuple(r.dependencies)) for r in M.cargo_lock(files).collect()} == {("x", "1.0", ("y", "z")), ("y", "0.1", ())}
    rules = spark.createDataFrame([("r1", "it's \\d+", "high", "*", "bad")], "id string, pattern string, severity string, language string, message string")
    assert "pattern-regex: 'it''s \\d+'" in E.semgrep(rules).first().document and '"level":"error"' in E.sarif_rule(rules).first().document


def test_short_values_are_found(spark):
    from vigil.operators import textscan

    texts = spark.createDataFrame([(1, "has abc inside"), (2, "nothing"), (3, "long-value.example here"), (4, None)], "id long, text string")
    values = spark.createDataFrame([("abc",), ("long-value.example",), ("",), ("zz",)], "value string")
    assert {(r.id, r.value) for r in textscan.contains_join(texts, "text", values, "value").collect()} == {(1, "abc"), (3, "long-value.example")}


def test_pieces_are_not_held(spark):
    """The heads in a batch of texts take little memory, and beyond the known heads the join finds the same."""
    import tracemalloc

    import pandas as pd

    from vigil.operators import textscan

    batch = pd.Series(["".join(map(chr, range(k, k + 20_000))) for k in range(200, 220)])
    tracemalloc.start()
    assert [len(x) for x in textscan.heads_in(batch, [6], frozenset(["none"]))] == [0] * 20
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5_000_000
    texts = spark.createDataFrame([(1, "has abc inside"), (2, "nothing"), (3, "long-value.example here"), (4, None), (5, "ab" * 2000 + "zz")], "id long, text string")
    values = spark.createDataFrame([("abc",), ("long-value.example",), ("",), ("zz",)], "value string")
    got = textscan.contains_join(texts, "text", values, "value", most=0)
    assert {(r.id, r.value) for r in got.collect()} == {(1, "abc"), (3, "long-value.example"), (5, "zz")}


def test_tiers_are_dealt_by_number(spark):
    from vigil.operators import correlation

    v = spark.range(100).selectExpr("id AS vid", "id AS cve", "1 AS cwe", "'f' AS family", "array('w') AS words")
    t = spark.range(3).selectExpr("id AS tid", "id AS cve", "1 AS cwe", "'f' AS family", "array('w') AS words")
    out = correlation.tiers(v, t, {"cve": 4.0, "cwe": 3.0, "family": 2.0, "word": 1.0}, rows=10)
    assert out.rdd.getNumPartitions() == 10 and out.count() == 300


def test_greedy_unique(spark):
    import random

    from vigil.operators import correlation

    r = random.Random(4)
    rows = [(i, r.choice([None, *(f"a{x}" for x in range(40))]), r.choice([None, *(f"b{x}" for x in range(60))])) for i in range(300)]
    seen, want = set(), []
    for i, a, b in rows:
        if not {a, b} & seen:
            want.append(i)
            seen |= {a, b} - {None}
    df = spark.createDataFrame(rows, "i long, a string, b string")
    for prefix in (correlation.PREFIX, 60):
        assert sorted(x.i for x in correlation.greedy_unique(df, "i", "a", "b", prefix).collect()) == want
    assert correlation.greedy_unique(df.limit(0), "i", "a", "b").collect() == []


def test_greedy_unique_chain(spark, monkeypatch):
    """Rows that hang together in a chain, each with the next: every second one stays, in few rounds, and little is left on disk."""
    import os

    from vigil.operators import correlation, graph, iterate

    made, real = [], iterate.cut

    def counted(df):
        made.append(real(df))
        return made[-1]

    for m in (correlation, graph):
        monkeypatch.setattr(m, "cut", counted)
    n = 100_000
    chain = spark.range(n).selectExpr("id AS i", "(id + 1) div 2 AS a", "id div 2 AS b")
    got = correlation.greedy_unique(chain, "i", "a", "b")
    assert got.selectExpr("sum(i % 2) odd", "count(*) n").first() == (0, n // 2)
    left = [x for x in made if os.path.exists(x._vigil_round.removeprefix("file:"))]
    assert len(made) < 40 and len(left) == 1  # the ids that are kept, which the result reads


def test_deep_dependency_path(spark):
    from vigil.operators import advisories

    tree = spark.createDataFrame([(f"p{i:02}", f"p{i - 1:02}" if i else None) for i in range(24)], "name string, parent string")
    got = {x.name: x.path for x in advisories.dependency_paths(tree).collect()}
    assert len(got) == 24 and got["p23"].count(" > ") == 23


def test_feeds(spark, tmp_path):
    import json

    from vigil.sources import feeds

    def put(name, data):
        (tmp_path / name).write_text(json.dumps(data))
        return f"{tmp_path}/{name}"

    kev = put("kev.json", {"vulnerabilities": [{"cveID": "CVE-2021-1", "vendorProject": "V", "product": "P", "dateAdded": "2024-01-02", "knownRansomwareCampaignUse": "Known"}, {"cveID": "CVE-2021-2"}]})
    got = {r.cve: r for r in feeds.exploited(spark, kev).collect()}
    assert got["CVE-2021-1"].ransomware and not got["CVE-2021-2"].ransomware and str(got["CVE-2021-1"].added) == "2024-01-02"
    events = [{"introduced": "0"}, {"fixed": "1.2.3"}]
    osv = put("osv.json", [
        {"id": "GHSA-1", "aliases": ["X", "CVE-2020-1"], "summary": "s", "database_specific": {"severity": "MODERATE", "cwe_ids": ["CWE-79"]}, "affected": [{"package": {"name": "Lib", "ecosystem": "npm"}, "ranges": [{"type": "SEMVER", "events": events}]}]},
        {"id": "OSV-2", "severity": [{"type": "CVSS_V3", "score": "9.8"}], "details": "d", "affected": [{"package": {"name": "other", "ecosystem": "npm"}}]},
    ])
    rows = {r.id: r for r in feeds.osv(spark, osv).collect()}
    assert (rows["GHSA-1"].cve, rows["GHSA-1"].package, rows["GHSA-1"].severity, rows["GHSA-1"].fixed, rows["GHSA-1"].cwes) == ("CVE-2020-1", "lib", "medium", ["1.2.3"], ["CWE-79"])
    assert (rows["OSV-2"].cve, rows["OSV-2"].severity, rows["OSV-2"].cvss, rows["OSV-2"].fixed, rows["OSV-2"].summary) == (None, "critical", 9.8, [], "d")
    github = put("github.json", [{"ghsa_id": "GHSA-1", "cve_id": "CVE-2020-1", "severity": "high", "cwes": [{"cwe_id": "CWE-79"}], "vulnerabilities": [{"package": {"ecosystem": "npm", "name": "lib"}, "first_patched_version": "1.2.3"}]}])
    nvd = put("nvd.json", {"vulnerabilities": [{"cve": {"id": "CVE-2020-9", "descriptions": [{"lang": "es", "value": "x"}, {"lang": "en", "value": "text"}], "metrics": {"cvssMetricV31": [{"cvssData": {"baseScore": 7.5}}]}, "weaknesses": [{"description": [{"lang": "en", "value": "CWE-20"}, {"lang": "en", "value": "NVD-CWE-noinfo"}]}]}}]})
    n = feeds.nvd(spark, nvd, "npm", "lib").first()
    assert (n.severity, n.cvss, n.cwes, n.summary) == ("high", 7.5, ["CWE-20"], "text")
    merged = feeds.merge([feeds.osv(spark, osv), feeds.github(spark, github), feeds.nvd(spark, nvd, "npm", "lib")]).collect()
    assert sorted((r.source, r.id) for r in merged) == [("nvd", "CVE-2020-9"), ("osv", "GHSA-1"), ("osv", "OSV-2")]
    cache = spark.sql("SELECT 'a' AS package, current_timestamp() AS fetched_at UNION ALL SELECT 'b', current_timestamp() - INTERVAL 9 HOURS")
    hits, misses = feeds.against_cache(spark.createDataFrame([("a",), ("b",), ("c",)], "package string"), cache, ["package"])
    assert [r.package for r in hits.collect()] == ["a"] and {r.package for r in misses.collect()} == {"b", "c"}


def test_relevance_of_classes(spark):
    """Against all pairs; rows that agree in all that counts are scored once, words that the other side lacks count in the share only."""
    from vigil.operators import correlation as Co

    c = [(i, i % 3 if i % 7 else None, ["a", "b", f"own{i}", *(["c"] if i % 2 else []), "a"]) for i in range(30)] + [(30, 1, None), (31, None, [])]
    t = [(i, i % 5 if i % 6 else None, [w for k, w in enumerate("abcde") if i >> k & 1]) for i in range(64)] + [(64, 1, None)]
    schema = "{} long, category int, words array<string>"
    out = Co.relevance(spark.createDataFrame(c, schema.format("cid")), spark.createDataFrame(t, schema.format("tid")), 0.2)
    got = sorted(map(tuple, out.collect()))
    score = lambda x, y: round((x[1] is not None and x[1] == y[1]) * 0.5 + min(len({*(x[2] or [])} & {*(y[2] or [])}) / max(1, len({*(x[2] or [])})) * 0.5, 0.4), 6)
    assert got == sorted((x[0], y[0], s) for x in c for y in t if (s := score(x, y)) >= 0.2)
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()  # pairs of rows are neither gathered nor counted


def test_relevance_in_blocks(spark, tmp_path, monkeypatch):
    """Ids that repeat or are null, classes of several blocks; the files of the pairs take a fraction of a byte for each."""
    from vigil.operators import correlation as Co

    schema = "{} long, category int, words array<string>"
    c, t = [(i, 1, ["a"]) for i in range(500)], [(i, 1 + i % 2, ["a"]) for i in range(3000)]
    c += [(7, 2, ["b", "c"]), (7, 1, ["a"]), (None, 1, ["a"])]
    t += [(9, 1, ["b"]), (9, 1, ["a"]), (None, 1, ["a"])]
    want = sorted((str(x[0]), str(y[0]), s) for x in c for y in t if (s := (x[1] == y[1]) * 0.5 + min(len({*x[2]} & {*y[2]}) / len(x[2]) * 0.5, 0.4)) >= 0.2)
    tables = spark.createDataFrame(c, schema.format("cid")), spark.createDataFrame(t, schema.format("tid"))
    Co.relevance(*tables, 0.2).write.parquet(f"{tmp_path}/one")
    monkeypatch.setattr(Co, "CONTROLS", 90)
    monkeypatch.setattr(Co, "THREATS", 400)
    Co.relevance(*tables, 0.2).write.parquet(f"{tmp_path}/more")
    for name in ("one", "more"):
        assert sorted((str(r.cid), str(r.tid), r.score) for r in spark.read.parquet(f"{tmp_path}/{name}").toLocalIterator()) == want
    assert sum(f.stat().st_size for f in (tmp_path / "one").glob("*.parquet")) < len(want) / 4


def test_scored_cross_join_of_odd_rows(spark, duck, tmp_path):
    """As its SQL: ids that repeat or are null, no category (no score), no name, names of blanks and of equal words."""
    from vigil import catalog

    duck = duck.cursor()
    rows = {
        "supplier": ("s_suppkey, s_nationkey", "(1::BIGINT, 1::INTEGER), (2, NULL), (2, 3), (NULL, 1), (4, 6), (5, 0)"),
        "part": ("p_partkey, p_name, p_size", "(1::BIGINT, 'small ring', 1::INTEGER), (2, 'small ring', NULL), (3, NULL, 1), (4, '', 1), (5, 'ring ring', 2), (6, 'steel small ring', 51), (6, 'steel small ring', 51), (NULL, 'steel small', 0), (8, 'small 4', -1), (9, ' small  ring ', 3)"),
    }
    for name, (columns, values) in rows.items():
        duck.sql(f"COPY (SELECT * FROM (VALUES {values}) v({columns})) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        duck.sql(f"CREATE TEMP VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = sorted(map(str, duck.sql(catalog.oracle_sql()["scored_cross_join"]).fetchall()))
    assert sorted(str(tuple(r)) for r in catalog.queries()["scored_cross_join"](spark, str(tmp_path)).collect()) == want


def test_jobs_of_one_interval_meet_events_once(spark, tmp_path):
    from vigil import catalog

    spark.sql("SELECT id AS o_orderkey, TIMESTAMP'1995-01-01' AS o_orderdate FROM range(300)").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT id AS event_id, TIMESTAMP'2024-01-02' AS ts FROM range(200)").write.parquet(f"{tmp_path}/events.parquet")
    out = catalog.queries()["interval_join_jobs"](spark, str(tmp_path))
    assert sorted(map(tuple, out.collect())) == [(i, 200) for i in range(300)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [at") == 1  # moments, not events, are joined
