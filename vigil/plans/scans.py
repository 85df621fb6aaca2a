"""Text scans; documents stand for source files, pages for entry points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import secrets as X
from ..operators import relational as R
from ..operators import textscan as T
from .registry import SQL, query, table

#: A small default rule set; larger ones are loaded from a table of (id, pattern, severity, language, category).
SECRET_RULES = [
    T.Rule("hex-token", r"token\s*=\s*\"[0-9a-f]{32,}\"", "high", category="secret"),
    T.Rule("aws-key", r"AKIA[0-9A-Z]{16}", "critical", category="secret", ignore_case=False),
    T.Rule("password", r"password\s*[:=]\s*['\"][^'\"]{4,}['\"]", "high", category="secret"),
    T.Rule("private-key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "critical", category="secret", ignore_case=False),
    T.Rule("api-key", r"api[_-]?key\s*[:=]\s*['\"]?[A-Za-z0-9]{16,}", "high", category="secret"),
]
PII_RULES = [
    T.Rule("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "medium", category="pii"),
    T.Rule("phone", r"\+?1?[ .-]?\(\d{3}\) ?\d{3}-\d{4}", "medium", category="pii"),
    T.Rule("card", r"\b\d{16}\b", "high", category="pii"),
    T.Rule("ip", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "low", category="pii"),
]
LICENSE_RULES = [T.Rule("mit", r"\bMIT License\b", "low", category="license"), T.Rule("apache", r"Apache License", "low", category="license"), T.Rule("gpl", r"General Public License", "high", category="license"), T.Rule("nc", r"BY-NC", "high", category="license")]

_LINES = "lines AS (SELECT doc_id, source, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS line_number, unnest(string_split(text, chr(10))) AS line FROM documents)"


def _scan_sql(rules: list[T.Rule]) -> str:
    q = lambda s: s.replace("'", "''")
    parts = [f"SELECT doc_id, line_number, '{r.id}' AS rule_id, '{r.severity}' AS severity, '{r.category}' AS category FROM lines WHERE regexp_matches(line, '{q(r.regex)}')" for r in rules]
    return f"WITH {_LINES} " + " UNION ALL ".join(parts)


def _scan(spark, sf_dir, rules):
    return T.scan(T.lines(table(spark, sf_dir, "documents"), "doc_id", "text"), rules).drop("line")


@query(_scan_sql(SECRET_RULES))
def secret_scan(spark, sf_dir):
    return _scan(spark, sf_dir, SECRET_RULES)


@query(_scan_sql(PII_RULES))
def pii_scan(spark, sf_dir):
    return _scan(spark, sf_dir, PII_RULES)


@query(_scan_sql(LICENSE_RULES))
def license_scan(spark, sf_dir):
    return _scan(spark, sf_dir, LICENSE_RULES)


@query(f"""
WITH {_LINES}, h AS (SELECT doc_id, line_number, regexp_extract(line, 'token = "([0-9a-f]+)"', 1) AS secret FROM lines WHERE regexp_matches(line, 'token = "[0-9a-f]+"')),
c AS (SELECT doc_id, line_number, secret, unnest(string_split(secret, '')) AS ch FROM h), g AS (SELECT doc_id, line_number, secret, ch, count(*) AS n FROM c GROUP BY ALL)
SELECT doc_id, line_number, left(secret, 4) || repeat('*', length(secret) - 8) || right(secret, 4) AS masked, round(-sum(n / length(secret) * log2(n / length(secret))), 6) AS entropy
FROM g GROUP BY doc_id, line_number, secret
""")
def secret_mask_entropy(spark, sf_dir):
    """Masked secrets with their entropy, all in JVM expressions."""
    lined = T.lines(table(spark, sf_dir, "documents"), "doc_id", "text").where(F.col("line").rlike('token = "[0-9a-f]+"'))
    s = F.regexp_extract("line", 'token = "([0-9a-f]+)"', 1)
    return lined.select("doc_id", "line_number", X.mask(s).alias("masked"), F.round(X.entropy(s), 6).alias("entropy"))


@query("""
WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), p AS (SELECT doc_id, l, CAST(generate_subscripts(l, 1) AS BIGINT) AS i, unnest(l) AS line FROM a)
SELECT doc_id, i AS line_number, md5(array_to_string(l[greatest(1, i - 5):least(len(l), i + 3)], chr(10))) AS context_md5 FROM p WHERE regexp_matches(line, '(?i)licen[sc]e')
""")
def line_context(spark, sf_dir):
    """Five lines before and three after each hit."""
    c = T.context(table(spark, sf_dir, "documents"), "doc_id", "text", 5, 3)
    return c.where(F.col("line").rlike("(?i)licen[sc]e")).select("doc_id", "line_number", F.md5("context").alias("context_md5"))


@query(f"""
WITH {_LINES}, n AS (SELECT doc_id, line_number, line, last_value(CASE WHEN length(line) < 60 AND line <> '' THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_number) AS section FROM lines)
SELECT doc_id, line_number, section FROM n
""")
def section_carry(spark, sf_dir):
    """The last short line so far is the section a line stands in."""
    return section_carry_whole(spark, sf_dir)


@query(SQL["section_carry"])
def section_carry_whole(spark, sf_dir):
    """The same under its second name."""
    lined = T.lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    out = T.carry(lined, "doc_id", "line_number", F.when((F.length("line") < 60) & (F.col("line") != ""), F.col("line")), "section")
    return out.select("doc_id", "line_number", "section")


_DIFFS = "concat('+++ b/src/', source, '.py', chr(10), '+', replace(text, chr(10), chr(10) || '+'), chr(10), ' unchanged')"


@query(f"""
WITH d AS (SELECT doc_id, {_DIFFS} AS diff FROM documents), l AS (SELECT doc_id, CAST(generate_subscripts(string_split(diff, chr(10)), 1) AS BIGINT) AS line_number, unnest(string_split(diff, chr(10))) AS line FROM d),
n AS (SELECT *, last_value(CASE WHEN starts_with(line, '+++ b/') THEN substr(line, 7) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_number) AS file FROM l)
SELECT doc_id, line_number, file, md5(substr(line, 2)) AS added_md5 FROM n WHERE starts_with(line, '+') AND NOT starts_with(line, '+++')
""")
def diff_file_carry(spark, sf_dir):
    """Added lines of a unified diff with their file."""
    return _added(table(spark, sf_dir, "documents"))


@query(SQL["diff_file_carry"])
def diff_file_carry_whole(spark, sf_dir):
    """The same under its second name."""
    return _added(table(spark, sf_dir, "documents"))


def _added(documents):
    d = documents.select("doc_id", F.expr(_DIFFS.replace("chr(10)", "'\\n'")).alias("diff"))
    return T.diff_lines(d, "doc_id", "diff").select("doc_id", "line_number", "file", F.md5("added").alias("added_md5"))


@query(f"""
WITH {_LINES}, f AS (SELECT doc_id, line_number, 'a' AS kind, 0 AS o FROM lines WHERE regexp_matches(line, '(?i)license') UNION ALL SELECT doc_id, line_number, 'b', 1 FROM lines WHERE regexp_matches(line, '(?i)licen[sc]e|rights')),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_number ORDER BY o, kind) AS rn FROM f)
SELECT doc_id, line_number, kind FROM r WHERE rn = 1
""")
def ordered_dedup(spark, sf_dir):
    """Findings of two scanners merged: the first scanner's row stays where both report a line."""
    lined = T.lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    a = lined.where(F.col("line").rlike("(?i)license")).select("doc_id", "line_number", F.lit("a").alias("kind"))
    b = lined.where(F.col("line").rlike("(?i)licen[sc]e|rights")).select("doc_id", "line_number", F.lit("b").alias("kind"))
    return R.first_writer([a, b], ["doc_id", "line_number"], ["kind"])


@query("""
SELECT page_id, regexp_matches(lower(url), 'admin|internal|debug') AS privileged, array_to_string(list_filter([CASE WHEN regexp_matches(lower(url), 'login|auth|token') THEN 'auth' END,
  CASE WHEN regexp_matches(lower(url), 'upload|file') THEN 'file' END, CASE WHEN regexp_matches(lower(html), '<form') THEN 'form' END, CASE WHEN regexp_matches(lower(html), '<script') THEN 'script' END,
  CASE WHEN starts_with(url, 'http://') THEN 'cleartext' END], lambda x: x IS NOT NULL), ',') AS tags FROM pages
""")
def endpoint_risk_tags(spark, sf_dir):
    """Risk tags of entry points from route and body."""
    p = table(spark, sf_dir, "pages")
    u, h = F.lower("url"), F.lower("html")
    tags = F.array(F.when(u.rlike("login|auth|token"), "auth"), F.when(u.rlike("upload|file"), "file"), F.when(h.rlike("<form"), "form"), F.when(h.rlike("<script"), "script"), F.when(F.col("url").startswith("http://"), "cleartext"))
    return p.select("page_id", u.rlike("admin|internal|debug").alias("privileged"), F.array_join(F.filter(tags, lambda x: x.isNotNull()), ",").alias("tags"))


@query("""
WITH v AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/]+)', 1) AS value FROM pages)
SELECT p.page_id, v.value FROM pages p JOIN v ON contains(p.html, v.value) WHERE length(v.value) > 0
""")
def ioc_substring_correlation(spark, sf_dir):
    """Indicators (hosts) that occur inside texts, by six-character grams."""
    p = table(spark, sf_dir, "pages")
    return T.contains_join(p.select("page_id", "html"), "html", p.select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("value")).distinct(), "value").select("page_id", "value")


@query("""
WITH x AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'https?://([A-Za-z0-9.-]+)', 1)) AS host FROM pages), v AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1)
SELECT page_id, host, n FROM x JOIN v USING (host)
""")
def cve_extract_join(spark, sf_dir):
    """Identifiers extracted from texts, then an equi-join with the table of known ones."""
    p = table(spark, sf_dir, "pages")
    found = p.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit("https?://([A-Za-z0-9.-]+)"), F.lit(1)))).alias("host"))
    known = p.groupBy(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host")).agg(F.count("*").alias("n"))
    return found.join(known, "host").select("page_id", "host", "n")


@query("""
SELECT url, CASE WHEN regexp_matches(v, '^\\d{1,3}(\\.\\d{1,3}){3}$') THEN 'ip' WHEN regexp_matches(v, '^https?://') THEN 'url' WHEN regexp_matches(v, '^[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+$') THEN 'domain' ELSE 'unknown' END AS kind
FROM (SELECT url, url AS v FROM pages UNION ALL SELECT url, regexp_extract(url, '^https?://([^/]+)', 1) FROM pages)
""")
def ioc_type_sniff(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    both = p.select("url", F.col("url").alias("v")).union(p.select("url", F.regexp_extract("url", "^https?://([^/]+)", 1)))
    return both.select("url", X.ioc_type(F.col("v")).alias("kind"))


@query("""
SELECT doc_id, upper(left(lang, 4)) || '_' || left(md5(lang || '|' || source || '|' || CAST(doc_id AS VARCHAR)), 8) AS threat_id, left(md5(source || ':' || CAST(n_chars AS VARCHAR) || ':' || lang), 12) AS flow_id, sha256(text) AS content_hash FROM documents
""")
def stable_ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.threat_id(F.col("lang"), F.col("lang"), F.col("source"), F.col("doc_id").cast("string")).alias("threat_id"), X.flow_id(F.col("source"), F.col("n_chars"), F.col("lang")).alias("flow_id"), F.sha2("text", 256).alias("content_hash"))


@query("""
SELECT lang, sum(len(string_split(text, chr(10)))) ::BIGINT AS lines, round(100.0 * sum(len(string_split(text, chr(10)))) / sum(sum(len(string_split(text, chr(10))))) OVER (), 4) AS percent FROM documents GROUP BY lang
""")
def language_percentages(spark, sf_dir):
    """Share of lines per language; the grand total is a scalar aggregate joined back, not an unpartitioned window."""
    n = table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(F.size(F.split("text", "\n"))).alias("lines"))
    return n.crossJoin(n.agg(F.sum("lines").alias("all")).hint("broadcast")).select("lang", "lines", F.round(100.0 * F.col("lines") / F.col("all"), 4).alias("percent"))


@query("""
WITH r AS (SELECT item_id, list_distinct(list_filter(string_split(lower(text), ' '), lambda w: length(w) > 4)) AS w FROM benchmark),
d AS (SELECT doc_id, list_distinct(list_filter(string_split(lower(text), ' '), lambda w: length(w) > 4)) AS w FROM documents),
a AS (SELECT item_id, unnest(w) AS x FROM r), b AS (SELECT doc_id, unnest(w) AS x FROM d)
SELECT item_id, doc_id, count(*) AS shared FROM a JOIN b USING (x) GROUP BY ALL HAVING count(*) >= 5
""")
def requirement_coverage(spark, sf_dir):
    """Requirements and texts that share at least five long words: an equi-join on words instead of a scored product."""
    return _covered(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


@query(SQL["requirement_coverage"])
def requirement_coverage_whole(spark, sf_dir):
    """The same under its second name."""
    return _covered(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def _covered(requirements, documents):
    words = lambda df, key: df.select(key, F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda w: F.length(w) > 4))).alias("x"))
    return words(requirements, "item_id").join(words(documents, "doc_id"), "x").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared")).where("shared >= 5")
