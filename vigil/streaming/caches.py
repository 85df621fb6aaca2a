"""Caches whose entries expire by event time: asks and answers in one stream, and the same as a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOUR = 3_600_000


class _Cache(StatefulProcessor):
    """Per key the newest answer; a timer frees it when the watermark is past its age limit."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "value string, fetched long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = held = self.entry.get() if self.entry.exists() else None
        out = []
        for r in pd.concat(list(rows)).sort_values(["ms", "asked", "row_id"]).itertuples(index=False):
            if not r.asked:
                held = (r.value, int(r.ms)) if held is None or r.ms >= held[1] else held
            else:
                hit = held is not None and held[1] <= r.ms <= held[1] + self.limit
                out.append((key[0], int(r.row_id), int(r.ms), "hit" if hit else "miss", held[0] if hit else None))
        if held is not None and held != before:
            self.entry.update(held)
            self.handle.registerTimer(held[1] + self.limit + 1)
        yield pd.DataFrame(out, columns=["key", "row_id", "ms", "outcome", "value"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        out = []
        if self.entry.exists() and self.entry.get()[1] + self.limit < due:
            self.entry.clear()
            out.append((key[0], None, due, "expired", None))
        yield pd.DataFrame(out, columns=["key", "row_id", "ms", "outcome", "value"])

    def close(self) -> None:
        pass


def cached(stream: DataFrame, max_age_hours: float = 6, late: str = "10 minutes") -> DataFrame:
    """(key, row_id, ms, outcome, value) for a stream of (key string, row_id long, at timestamp, ask boolean, value string).

    An ask is a hit if the newest answer of its key is not younger than the ask and at most ``max_age_hours`` old then;
    what is a miss should be fetched and come back as an answer. When the watermark passes the age limit an entry goes,
    with a row "expired". Rows of one key are taken in order of time within a batch, answers before asks of the same
    moment; an ask that comes after a newer answer was taken is a miss. Rows without key or time are left out. Needs the
    RocksDB state store; state is one entry per living key.
    """
    marked = stream.where("key IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)
    rows = marked.select("key", "row_id", F.unix_millis("at").alias("ms"), F.coalesce("ask", F.lit(False)).alias("asked"), "value", "at")
    limit = int(max_age_hours * HOUR)
    return rows.groupBy("key").transformWithStateInPandas(_Cache(limit), "key string, row_id long, ms long, outcome string, value string", "append", "eventTime")


def cached_batch(rows: DataFrame, max_age_hours: float = 6) -> DataFrame:
    """The outcomes of all asks of a table with the columns of ``cached``, as if every row came in order of time."""
    known = rows.where("key IS NOT NULL AND at IS NOT NULL").withColumn("ask", F.coalesce("ask", F.lit(False)))
    before = Window.partitionBy("key").orderBy("at", "ask", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(~F.col("ask"), F.struct("value", "at")), ignorenulls=True).over(before)
    aged = known.withColumn("_e", last).where("ask")
    hit = F.coalesce(F.unix_millis("at") <= F.unix_millis("_e.at") + int(max_age_hours * HOUR), F.lit(False))
    return aged.select("key", "row_id", F.unix_millis("at").alias("ms"), F.when(hit, "hit").otherwise("miss").alias("outcome"), F.when(hit, F.col("_e.value")).alias("value"))
