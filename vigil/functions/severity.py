"""Severity ranks, scores and buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Order of severities, and the weights, caps and scores that results must reproduce.
RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}
WEIGHT = {"critical": 10, "high": 7, "medium": 4, "low": 1, "info": 0}
CVSS = {"critical": 9.5, "high": 7.5, "medium": 5.5, "low": 3.0, "info": 0.0}


def _lookup(values: dict, key: Column, default) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(F.lower(key) == k, F.lit(v)) if out is None else out.when(F.lower(key) == k, F.lit(v))
    return out.otherwise(F.lit(default))


def rank(severity: Column) -> Column:
    """Critical 4 to info 0; anything else -1. Text order is not severity order."""
    return _lookup(RANK, severity, -1)


def weight(severity: Column) -> Column:
    return _lookup(WEIGHT, severity, 0)


def cvss(severity: Column) -> Column:
    return _lookup(CVSS, severity, 5.0)


def from_cvss(score: Column) -> Column:
    """CVSS v3 buckets."""
    return F.when(score >= 9.0, "critical").when(score >= 7.0, "high").when(score >= 4.0, "medium").when(score > 0, "low").otherwise("info")


def scaled_risk(total: Column) -> Column:
    """A sum of weights on a scale of 0 to 10: min(10, 3 log10(sum + 1)); 0 without findings."""
    return F.least(F.lit(10.0), F.log10(F.coalesce(total, F.lit(0)) + 1) * 3)


def level(score: Column) -> Column:
    """Risk level of a score of 0 to 10."""
    return F.when(score >= 7.0, "critical").when(score >= 4.0, "high").when(score >= 2.0, "medium").when(score >= 0.5, "low").otherwise("clean")
