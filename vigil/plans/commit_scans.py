"""Commits from diff to score. Every document stands for a commit: its lines, with what the tests look for, are the diff."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import commit_signals as G
from ..operators.iterate import cut
from ..operators.textscan import Rule
from .registry import query, table

FILES = ["package.json", "backend/requirements.txt", "Dockerfile", "dockerfile", ".github/workflows/ci.yml", "src/config.py", "deploy/nginx.conf", ".gitignore", "docs/CODEOWNERS", "README.md", "Settings.YAML", "my-package.json"]
ADDED = [
    '"postinstall": "x"', "send a request to the server", "RUN useradd x", "EXPOSE 8080", "DEBUG = True", "verify_ssl = False", "FROM ubuntu", "FROM my.gcr.io/x", 'registry = "https://evil.example"', 'registry: "https://pypi.org"', "Django==1.8",
    "curl -H $TOKEN", "SKIP_SCAN=1", "git commit --no-verify", "cors: *", "echo $DB_PASSWORD | x", "plain", "MFA_ENABLED = off", "# run semgrep later", "deploy to prod",
]
REMOVED = ['"helmet": "^4.0.0",', "- run: snyk test", ".env", "*.pem", "nothing", "* @team", "# note", "", "bandit and safety", "build/"]
RULES = [Rule("password", r"[Pp]assw(or)?d|PASSWORD", "critical", ignore_case=False), Rule("token", r"token\s*=|TOKEN", "high", ignore_case=False), Rule("mail", r"[a-z0-9.]+@[a-z0-9.]+\.com", "medium", ignore_case=False)]

_q = lambda s: "'" + s.replace("'", "''") + "'"


def commits(spark, sf_dir):
    """Commits (analyze()'s columns) from documents; the sha is the doc_id."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.split(F.regexp_replace(F.coalesce("text", F.lit("")), G.LINE_BREAK, " "), "\n").alias("l"), F.coalesce("n_chars", F.lit(0)).alias("n"))
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))
    doc = F.col("doc_id")

    def line(x, i):
        k = (doc + i) % 9
        return (
            F.when(k == 0, F.concat(F.lit("+++ b/"), pick(FILES, doc + i))).when(k.isin(1, 2, 3), F.concat(F.lit("+"), pick(ADDED, doc * 7 + i), F.lit(" "), x))
            .when(k.isin(4, 5), F.concat(F.lit("-"), pick(REMOVED, doc * 5 + i), F.lit(" "), x)).otherwise(F.concat(F.lit(" "), x))
        )

    named = F.filter("lines", lambda x: x.startswith("+++ b/"))
    files = F.transform(named, lambda x: F.struct(F.substring_index(x, "+++ b/", -1).alias("filename"), F.lit("modified").alias("status")))
    more = F.array(*[F.struct(F.lit(n).alias("filename"), pick(["added", "modified", "removed"], doc).alias("status")) for n in ("bin/tool.EXE", "conf/id_rsa")])
    d = d.withColumn("lines", F.transform("l", line))
    return d.select(
        doc.alias("sha"), pick(["stuff", "", "Fix ", "Describe the change"], doc).alias("message"), F.concat(F.lit("2024-01-01T"), F.lpad((doc % 24).cast("string"), 2, "0"), F.lit(":30:00Z")).alias("committed_at"),
        F.lit("x@a").alias("author"), pick(["X@A", "y@b", "noreply@host"], doc).alias("committer"), (doc % 2 == 0).alias("verified"), (doc % 5 == 0).alias("forced"), F.col("n").alias("deletions"), F.col("n").alias("changes"),
        F.when(doc % 4 == 0, F.concat(files, more)).otherwise(files).alias("files"), F.array_join("lines", "\n").alias("diff"),
    )


def _matches(x: str, pattern: str, flag: str = "(?i)") -> str:
    """RE2 has no lookahead: what must not follow is a second test (a line has one occurrence at most)."""
    if m := re.fullmatch(r"(.*)\(\?!(.*)\)", pattern):
        return f"(regexp_matches({x}, {_q(flag + m[1])}) AND NOT regexp_matches({x}, {_q(f'{flag}{m[1]}({m[2]})')}))"
    return f"regexp_matches({x}, {_q(flag + pattern)})"


def _sql() -> str:
    pick = lambda words, n: f"(CAST([{', '.join(map(_q, words))}] AS VARCHAR[]))[({n}) % {len(words)} + 1]"
    labels = lambda ps, flag="(?i)": "list_filter([" + ", ".join(f"CASE WHEN {_matches('rest', p, flag)} THEN {_q(l)} END" for p, l in ps) + "], lambda x: x IS NOT NULL)"
    named = lambda ws, l: "list_filter([" + ", ".join(f"CASE WHEN contains(lower(rest), {_q(w)}) THEN {_q(l)} END" for w in ws) + "], lambda x: x IS NOT NULL)"
    base = "regexp_extract(file, '[^/]*$')"
    deps, pipes = f"{base} IN ({', '.join(map(_q, G.DEPENDENCY_FILES))})", _matches("file", "(" + "|".join(G.CICD_FILES) + ")")
    conf = "(" + _matches("file", "(" + "|".join(G.CONFIG_FILES) + ")") + "".join(f" OR contains(lower(file), {_q(w)})" for w in G.CONFIG_WORDS) + ")"
    secret = f"ends_with(file, '.gitignore') AND {_matches('entry', '(' + '|'.join(G.IGNORE_REMOVAL) + ')')}"
    own = "list_filter([CASE WHEN " + secret + " THEN 'gitignore_sensitive_unignored' END, CASE WHEN contains(lower(file), 'codeowners') THEN 'codeowner_removed' END], lambda x: x IS NOT NULL)"
    some = lambda n, c: f"CASE WHEN len({c}) > 0 THEN '{n}:' || array_to_string(list_sort(list_distinct({c})), ',') END"
    count = lambda n, c: f"CASE WHEN {c} > 0 THEN '{n}:' || {c} END"
    flat = lambda c: f"coalesce(flatten(list({c})), [])"
    rules = " UNION ALL ".join(f"SELECT doc_id, '{r.severity}' AS severity FROM seen WHERE sign = '+' AND NOT starts_with(line, '+++ b/') AND regexp_matches(rest, {_q(r.pattern)})" for r in RULES)
    return rf"""
WITH d AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), {_q(G.LINE_BREAK)}, ' ', 'g'), chr(10)) AS l, coalesce(n_chars, 0) AS n FROM documents
), i AS (SELECT doc_id, n, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS i FROM d
), lines AS (SELECT doc_id, n, i, CASE WHEN (doc_id + i) % 9 = 0 THEN '+++ b/' || {pick(FILES, 'doc_id + i')} WHEN (doc_id + i) % 9 <= 3 THEN '+' || {pick(ADDED, 'doc_id * 7 + i')} || ' ' || x
    WHEN (doc_id + i) % 9 <= 5 THEN '-' || {pick(REMOVED, 'doc_id * 5 + i')} || ' ' || x ELSE ' ' || x END AS line FROM i
), seen AS (SELECT *, left(line, 1) AS sign, substr(line, 2) AS rest, trim(substr(line, 2), chr(32) || chr(9)) AS entry, last_value(CASE WHEN starts_with(line, '+++ b/') THEN substr(line, 7) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS file FROM lines
), alerts AS (SELECT doc_id,
    CASE WHEN NOT {deps} THEN [] WHEN sign = '+' AND NOT starts_with(line, '+++') THEN {labels(G.DEPENDENCY_TAMPERING)} WHEN sign = '-' AND NOT starts_with(line, '---') THEN {named(G.SECURITY_DEPENDENCIES, 'security_dep_removed')} ELSE [] END AS dep,
    CASE WHEN NOT {pipes} THEN [] WHEN sign = '+' AND NOT starts_with(line, '+++') THEN {labels(G.CICD_TAMPERING)} WHEN sign = '-' AND NOT starts_with(line, '---') THEN {named(G.CICD_TOOLS, 'security_tool_removed')} ELSE [] END AS cicd,
    CASE WHEN NOT {conf} THEN [] WHEN sign = '+' AND NOT starts_with(line, '+++') THEN {labels(G.CONFIG_WEAKENING, '')} WHEN sign = '-' AND NOT starts_with(line, '---') AND entry <> '' AND NOT starts_with(entry, '#') THEN {own} ELSE [] END AS conf
  FROM seen WHERE file IS NOT NULL
), a AS (SELECT doc_id, {flat('dep')} AS dep, {flat('cicd')} AS cicd, {flat('conf')} AS conf FROM alerts GROUP BY doc_id
), f AS (SELECT doc_id, sum(({_matches('file', '(' + '|'.join(G.SENSITIVE) + ')')})::INT) AS sensitive FROM (SELECT doc_id, substr(line, 7) AS file FROM seen WHERE starts_with(line, '+++ b/')) GROUP BY doc_id
), hit AS ({rules}
), s AS (SELECT doc_id, count(*) AS found, count_if(severity = 'critical') AS critical, count_if(severity = 'high') AS high FROM hit GROUP BY doc_id
), c AS (SELECT d.doc_id, d.n, d.doc_id % 24 < 7 OR d.doc_id % 24 >= 21 AS off, d.doc_id % 3 = 1 AS mismatch, d.doc_id % 2 <> 0 AS unsigned, d.doc_id % 5 = 0 AS forced, d.n > 500 AS large,
    CASE WHEN d.n >= 50 THEN CASE d.doc_id % 4 WHEN 0 THEN 'vague' WHEN 1 THEN 'empty' WHEN 2 THEN 'empty' END END AS message,
    coalesce(f.sensitive, 0) + (d.doc_id % 4 = 0)::INT AS sensitive, (d.doc_id % 4 = 0 AND d.doc_id % 3 < 2)::INT AS binary_n, coalesce(a.dep, []) AS dep, coalesce(a.cicd, []) AS cicd, coalesce(a.conf, []) AS conf,
    coalesce(s.found, 0) AS found, coalesce(s.critical, 0) AS critical, coalesce(s.high, 0) AS high
  FROM d LEFT JOIN a USING (doc_id) LEFT JOIN f USING (doc_id) LEFT JOIN s USING (doc_id)
), p AS (SELECT *, least(10.0, off::INT * 1.0 + mismatch::INT * 1.5 + unsigned::INT * 0.5 + forced::INT * 2.0 + large::INT * 1.0 + (message IS NOT NULL)::INT * 0.5 + least(sensitive * 1.5, 3.0) + least(binary_n * 1.0, 2.0)
    + (len(dep) > 0)::INT * 1.5 + least(len(cicd) * 1.5, 3.0) + least(len(conf) * 1.0, 2.0) + critical * 2.5 + high * 1.5 + (found - critical - high) * 0.5)::DOUBLE AS score FROM c)
SELECT doc_id AS sha, score, CASE WHEN score >= 7 THEN 'critical' WHEN score >= 4 THEN 'high' WHEN score >= 2 THEN 'medium' WHEN score >= 0.5 THEN 'low' ELSE 'clean' END AS level,
  array_to_string(list_filter([CASE WHEN off THEN 'off_hours' END, CASE WHEN mismatch THEN 'author_committer_mismatch' END, CASE WHEN unsigned THEN 'unsigned_commit' END, CASE WHEN forced THEN 'force_push' END, CASE WHEN large THEN 'large_deletion' END,
    {count('sast_findings', 'found')}, {count('sensitive_files', 'sensitive')}, 'suspicious_message:' || message, {count('binary_files', 'binary_n')}, {some('dependency_tampering', 'dep')}, {some('cicd_tampering', 'cicd')}, {some('config_weakening', 'conf')}], lambda x: x IS NOT NULL), ' ') AS signals
FROM p
"""


@query(_sql())
def commit_analysis(spark, sf_dir):
    """Scores of all commits: metadata, files, message, manifests, pipelines, configuration and findings in their diffs."""
    c = cut(commits(spark, sf_dir))
    return G.analyze(c, G.scan_diffs(c, RULES)).withColumn("signals", F.array_join("signals", " "))


@query(rf"""
WITH d AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), {_q(G.LINE_BREAK)}, ' ', 'g'), chr(10)) AS l FROM documents
), i AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS i FROM d
), k AS (SELECT doc_id, i, CASE WHEN (doc_id + i) % 9 = 0 THEN '+++ b/' || {f"(CAST([{', '.join(map(_q, FILES))}] AS VARCHAR[]))[(doc_id + i) % {len(FILES)} + 1]"}
    WHEN (doc_id + i) % 9 <= 3 THEN '+' || {f"(CAST([{', '.join(map(_q, ADDED))}] AS VARCHAR[]))[(doc_id * 7 + i) % {len(ADDED)} + 1]"} || ' ' || x ELSE '' END AS line FROM i
), n AS (SELECT *, last_value(CASE WHEN starts_with(line, '+++ b/') THEN substr(line, 7) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS file FROM k
), r AS ({" UNION ALL ".join(f"SELECT doc_id AS sha, '{r.id}' AS rule_id, '{r.severity}' AS severity, file, i + 1 AS line_number, md5(left(substr(line, 2), 200)) AS matched_md5 FROM n WHERE starts_with(line, '+') AND NOT starts_with(line, '+++ b/') AND regexp_matches(substr(line, 2), {_q(r.pattern)})" for r in RULES)})
SELECT * FROM r
""")
def commit_findings(spark, sf_dir):
    """Added lines of all diffs that match a rule, with their file and place."""
    return G.scan_diffs(commits(spark, sf_dir), RULES).select("sha", "rule_id", "severity", "file", "line_number", F.md5("matched_text").alias("matched_md5"))
