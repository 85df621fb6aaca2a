"""Ordered keyword classes, match scores, likelihood and impact, token overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The first class whose keyword occurs wins.
STRIDE = (
    ("spoofing", ("auth", "credential", "session", "password", "login")), ("tampering", ("injection", "xss", "deserial", "tamper", "traversal")),
    ("repudiation", ("log", "audit")), ("information disclosure", ("exposure", "leak", "secret", "disclosure")), ("denial of service", ("dos", "resource", "redos")), ("elevation of privilege", ("privilege", "access control", "idor")),
)
STOP_WORDS = ("the", "and", "for", "with", "that", "this", "from", "are", "was", "not")


def first_class(text: Column, classes=STRIDE, default: str = "tampering") -> Column:
    low = F.lower(text)
    out = F.when(F.lit(False), "")
    for name, words in classes:
        test = F.lit(False)
        for w in words:
            test = test | low.contains(w)
        out = out.when(test, name)
    return out.otherwise(default)


def tokens(text: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    words = F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) > 2))
    return F.array_except(words, F.array(*map(F.lit, stop)))


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller set; 0 when one is empty."""
    small = F.least(F.size(a), F.size(b))
    return F.when(small == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / small)


def match_score(base: Column, exploited: Column, age_days: Column, cvss: Column, multiple: Column) -> Column:
    """base, half as much again if exploited, boosted when recent, by CVSS / 20 and by a tenth for several kinds of match."""
    recent = F.when(age_days <= 7, 1.3).when(age_days <= 30, 1.1).otherwise(1.0)
    return base * F.when(exploited, 1.5).otherwise(1.0) * recent * (1 + F.coalesce(cvss, F.lit(0.0)) / 20) * F.when(multiple, 1.1).otherwise(1.0)


def adjusted_risk(risk: Column, internet: Column, sensitive: Column, privileged: Column) -> Column:
    """Plus 1.0, 0.5 and 0.5, at most 10."""
    plus = lambda c, k: F.when(c, k).otherwise(0.0)
    return F.least(F.lit(10.0), risk + plus(internet, 1.0) + plus(sensitive, 0.5) + plus(privileged, 0.5))


def uses_variable(text: Column, name: Column) -> Column:
    """Does ``text`` use the name as a word of its own."""
    return F.regexp_like(text, F.concat(F.lit(r"(?<![\w$])"), F.regexp_replace(name, r"([.\\+*?\[^\]$(){}=!<>|:\-])", r"\\$1"), F.lit(r"(?![\w$])")))
