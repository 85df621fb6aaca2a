"""Masks, entropy, confidence and type of secrets and indicators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mask(s: Column) -> Column:
    """Up to 8 characters: all hidden; up to 16: two at either end stay; longer: four."""
    n = F.length(s)
    stars = lambda k: F.expr("repeat('*', 1)") if k is None else F.repeat(F.lit("*"), k)
    keep = lambda k: F.concat(F.left(s, F.lit(k)), stars(n - 2 * k), F.right(s, F.lit(k)))
    return F.when(n <= 8, stars(n)).when(n <= 16, keep(2)).otherwise(keep(4))


def entropy(s: Column) -> Column:
    """Shannon entropy in bits per character; 0 for the empty string."""
    chars = F.split(s, "")
    n = F.size(chars)
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.when(F.length(s) == 0, 0.0).otherwise(-F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + share(c) * F.log2(share(c))))


def secret_confidence(low_entropy: Column, test_file: Column, placeholder: Column, comment: Column) -> Column:
    """100 less 30, 25, 40 and 50; from 70 high, from 40 medium."""
    cut = lambda c, k: F.when(c, k).otherwise(0)
    s = F.lit(100) - cut(low_entropy, 30) - cut(test_file, 25) - cut(comment, 40) - cut(placeholder, 50)
    return F.when(s >= 70, "high").when(s >= 40, "medium").otherwise("low")


def ioc_type(v: Column) -> Column:
    """Kind of indicator by its form; the first that fits."""
    return (
        F.when(v.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip").when(v.rlike("^[0-9a-fA-F]{64}$"), "hash_sha256").when(v.rlike("^[0-9a-fA-F]{40}$"), "hash_sha1").when(v.rlike("^[0-9a-fA-F]{32}$"), "hash_md5")
        .when(v.rlike("^https?://"), "url").when(v.rlike(r"^(?i)cve-\d{4}-\d{4,}$"), "cve").when(v.rlike(r"^[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$"), "domain").otherwise("unknown")
    )


def threat_id(category: Column, *parts: Column) -> Column:
    """Stable id: four letters of the category and eight digits of an MD5 over the parts."""
    return F.concat(F.upper(F.left(category, F.lit(4))), F.lit("_"), F.left(F.md5(F.concat_ws("|", *parts)), F.lit(8)))


def flow_id(file: Column, line: Column, sink: Column) -> Column:
    return F.left(F.md5(F.concat_ws(":", file, line.cast("string"), sink)), F.lit(12))
