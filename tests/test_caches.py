"""The expiring cache as a stream, with expiry and a restart from its checkpoint, against the batch and by hand."""

import random

from vigil.streaming import caches as K

SCHEMA = "key string, row_id long, at timestamp, ask boolean, value string"


def _rows(spark, rows):
    return spark.createDataFrame([(k, i, None if ms is None else ms / 1000, a, v) for k, i, ms, a, v in rows], "key string, row_id long, s double, ask boolean, value string").selectExpr("key", "row_id", "timestamp_millis(CAST(round(s * 1000) AS LONG)) AS at", "ask", "value")


def _run(spark, tmp, batches, hours):
    """One query per batch, each started from the checkpoint of the one before."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for b in batches:
            _rows(spark, b).coalesce(1).write.mode("append").parquet(f"{tmp}/in")
            out = K.cached(spark.readStream.schema(SCHEMA).parquet(f"{tmp}/in"), hours, "0 seconds")
            q = out.writeStream.format("parquet").option("path", f"{tmp}/out").option("checkpointLocation", f"{tmp}/check").trigger(availableNow=True).start()
            assert q.awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.parquet(f"{tmp}/out")


def test_hits_misses_expiry_restart(spark, tmp_path):
    h = K.HOUR
    first = [("a", 1, h, True, None), ("a", 2, h + 1, False, "x"), ("a", 3, 2 * h, True, None), ("b", 4, 2 * h, False, None), ("b", 5, 2 * h, True, None), (None, 6, h, True, None), ("c", 7, None, True, None), ("c", 8, h, None, "v")]
    second = [("a", 9, 3 * h + 1, True, None), ("a", 10, 3 * h + 2, True, None), ("a", 11, 3 * h + 3, False, "y"), ("a", 12, 3 * h + 3, True, None), ("a", 13, 3 * h + 2, False, "late")]
    third = [("b", 14, 9 * h, True, None), ("a", 15, 9 * h, True, None)]
    got = [(r.key, r.row_id, r.outcome, r.value) for r in _run(spark, tmp_path, [first, second, third], 2).collect()]
    # 13 is an answer of the moment of 10 and comes first; 11 is newer than 13 and stays, until it expires
    want = [
        ("a", 1, "miss", None), ("a", 3, "hit", "x"), ("b", 5, "hit", None), ("a", 9, "hit", "x"), ("a", 10, "hit", "late"), ("a", 12, "hit", "y"), ("b", 14, "miss", None), ("a", 15, "miss", None),
        ("a", None, "expired", None), ("b", None, "expired", None), ("c", None, "expired", None),
    ]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_stream_equals_batch(spark, tmp_path):
    r = random.Random(7)
    rows = [(f"k{r.randrange(6)}", i, i * 400_000 + r.randrange(300_000), r.random() < 0.6, r.choice(["v", "w", None])) for i in range(120)]
    got = _run(spark, tmp_path, [rows[:50], rows[50:120]], 1).where("outcome <> 'expired'").collect()
    want = K.cached_batch(_rows(spark, rows), 1).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str) and {x.outcome for x in want} == {"hit", "miss"}


def test_nothing(spark):
    assert K.cached_batch(spark.createDataFrame([], SCHEMA)).collect() == []
