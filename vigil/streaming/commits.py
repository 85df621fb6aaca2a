"""Streaming twins: incremental ingest, tumbling counts, running profiles and detection before update."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LAST = 60


def fresh(commits: DataFrame, keys: list[str], at: str, late: str = "7 days") -> DataFrame:
    """Each key once; state for keys is dropped behind the watermark."""
    return commits.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def daily(commits: DataFrame, at: str, level: str, late: str | None = "1 day") -> DataFrame:
    """Counts per day and level, emitted when a day is closed; late=None where the stream has a watermark already."""
    marked = commits if late is None else commits.withWatermark(at, late)
    return marked.groupBy(F.window(at, "1 day"), level).count().select(F.col("window.start").alias("day"), level, "count")


def profiles(commits: DataFrame, key: str, value: str) -> DataFrame:
    """Running totals per author, for update or complete mode."""
    return commits.groupBy(key).agg(F.count("*").alias("commits"), F.avg(value).alias("mean"), F.max(value).alias("peak"))


def detect(commits: DataFrame, key: str = "user_id", value: str = "value", at: str = "ts", row: str = "event_id", z_high: float = 3.0, z_low: float = 2.0) -> DataFrame:
    """Anomalies against the last 60 values of the author before each row; the state is updated after the decision."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values([at, row])
        out = []
        for r in rows.itertuples():
            v, n = float(getattr(r, value)), len(past)
            if n >= 5:
                m = sum(past) / n
                s = max(1.0, (sum((x - m) ** 2 for x in past) / n) ** 0.5)
                p90 = sorted(past)[min(n * 90 // 100, n - 1)]
                z = (v - m) / s
                severity = ("medium" if v > p90 * 1.5 else None) if n < 20 else "high" if z >= z_high else "medium" if z >= z_low else None
                if severity:
                    out.append((int(k[0]), int(getattr(r, row)), n, severity, z))
            past = [*past, v][-LAST:]
        state.update((past,))
        yield pd.DataFrame(out, columns=[key, row, "prior_n", "severity", "z"])

    schema = f"{key} long, {row} long, prior_n long, severity string, z double"
    return commits.groupBy(key).applyInPandasWithState(step, schema, "past array<double>", "append", GroupStateTimeout.NoTimeout)


def merge_batches(stream: DataFrame, path: str, merge) -> object:
    """A foreachBatch sink: ``merge(batch, batch_id)`` must be idempotent per batch id; ``path`` holds the checkpoint."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", path).trigger(availableNow=True)
