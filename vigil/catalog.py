"""All registered queries of the engine, by name, and the SQL that checks each of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import caches, commit_scans, commits, dashboards, dataflow, dependencies, increments, models, precision, programs, reachability, rulesets, scans, threats, triage  # noqa: F401  registers their queries
from .plans.registry import QUERIES, SQL

FLAGSHIP = "developer_anomalies"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
