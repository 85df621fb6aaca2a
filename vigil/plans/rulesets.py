"""A catalog of hundreds of rules over all documents."""

from __future__ import annotations

from ..operators import prefilter
from ..operators.textscan import Rule
from .registry import query, table

STEMS = ["license", "copyright", "permission", "warrant", "liabilit", "password", "token", "reserved", "notice", "redistribut", "tion", "ment", "keit", "schaft", "ique", "eaux", "there", "which", "under", "would", "people", "about", "stupid", "hate", "kill", "contact", "http", "class", "return", "import"]
FORMS = ["{s}", "{s}[a-z]{{1,3}} (of|and|the) ", "(re|un|in){s}", "{s}[.,;] [A-Z]", "(^|[^a-z]){s}s?([^a-z]|$)", "{s}.*{s}", "[0-9]+[^a-z]*{s}", "[a-z]{{2}}{s}(ing|ed|er)"]
LEVELS = ("low", "medium", "high", "critical")

#: Every form of every stem, and two patterns without a literal, which are tried on all lines.
RULES = [Rule(f"{s}-{i}", f.format(s=s), LEVELS[(n + i) % 4], category=f"form{i}") for n, s in enumerate(STEMS) for i, f in enumerate(FORMS)]
RULES += [Rule("digits", "[0-9]{6}", "low", category="any"), Rule("capitals", "[A-Z]{4}", "medium", category="any", ignore_case=False)]

_q = lambda s: "'" + s.replace("'", "''") + "'"
_each = ", ".join(f"CASE WHEN regexp_matches(line, {_q(r.regex)}) THEN {{'id': {_q(r.id)}, 'severity': '{r.severity}', 'category': '{r.category}'}} END" for r in RULES)


@query(f"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), n AS (SELECT doc_id, unnest(l) AS line, CAST(generate_subscripts(l, 1) AS BIGINT) AS line_number FROM d),
h AS (SELECT doc_id, line_number, unnest(list_filter([{_each}], lambda x: x IS NOT NULL)) AS h FROM n)
SELECT doc_id, line_number, h.id AS rule_id, h.severity AS severity, h.category AS category FROM h
""")
def rule_catalog_scan(spark, sf_dir):
    """242 rules over whole texts: patterns are tried only on lines that hold a literal they need."""
    return prefilter.scan(table(spark, sf_dir, "documents"), "doc_id", "text", RULES).select("doc_id", "line_number", "rule_id", "severity", "category")
