"""Suppression and confidence of findings on lines whose outcome is known."""

from pyspark.sql import functions as F

from vigil.operators import precision as P

# name, severity, language, path, line, match, suppressed, confidence, shifted
CASES = [
    ("SQL Injection", "critical", "python", "src/a.py", "cursor.execute(q + request.args['x'])", "cursor", False, "high", "critical"),
    ("SQL Injection", "critical", "python", "src/a.py", "cursor.execute(q + x)", "cursor", False, "medium", "high"),
    ("SQL Injection", "critical", "python", "src/a.py", "cursor.execute(q, (x,))", "cursor", False, "info", None),
    ("SQL Injection", "critical", "python", "tests/a.py", "cursor.execute(q + request.args['x'])", "cursor", False, "medium", "medium"),
    ("SQL Injection", "critical", "python", "src/a.py", "User.objects.get(id=x)", "User", True, "medium", "high"),
    ("SQL Injection", "critical", None, "src/a.py", "run(q + x)", "run", False, "high", "high"),
    ("Hardcoded Credentials", "high", "python", "src/a.py", "password = 'changeme'", "password", True, "medium", "high"),
    ("Hardcoded Credentials", "high", "python", "src/a.py", "password = 'dummyvalue'", "password", False, "info", "high"),
    ("Weak Cryptography", "medium", "python", "src/a.py", "logger.warn('md5', x)", "md5", False, "info", None),
    ("Other", "high", "python", "src/a.py", "f('it\\'s x', eval)", "x", False, "medium", "low"),
    ("Other", "high", "python", "src/a.py", "f('it\\'s x', eval)", "eval", False, "medium", "high"),
    ("Other", "low", "python", "src/a.py", "x = 1 # y", "x", True, "low", "low"),
    ("Other", "low", "javascript", "src/a.js", "x = 1 # y", "x", False, "low", "low"),
    ("Other", "low", "python", "src/a.py", "   ", " ", True, "low", "low"),
    ("Other", "low", None, None, None, " ", True, "low", "low"),
]


def test_findings_are_judged(spark):
    rows = [(i, *c[:5], (c[4] or "").find(c[5])) for i, c in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, name string, severity string, language string, path string, line string, at int")
    c = {k: F.col(k) for k in df.columns}
    out = df.select(
        "i", P.suppressed(c["line"], c["name"], c["language"]).alias("suppressed"), P.confidence(c["severity"], c["name"], c["line"], c["path"], c["language"], c["line"]).alias("confidence"),
        P.shifted(c["severity"], c["name"], c["line"], c["at"], c["path"], c["language"], c["line"]).alias("shifted"),
    )
    got = {r.i: (r.suppressed, r.confidence, r.shifted) for r in out.collect()}
    assert got == {i: c[6:] for i, c in enumerate(CASES)}


def test_comments_by_language(spark):
    rows = [("  # note", "python"), ("x = 1 # y", "python"), ("x = 1", "python"), ("/* x", "go"), ("# x", "go"), ("# x", None), (None, "go")]
    df = spark.createDataFrame(rows, "line string, language string").select(P.is_comment(F.col("line"), F.col("language")).alias("c"))
    assert [r.c for r in df.collect()] == [True, True, False, True, False, False, False]
