"""Cutting lineage between rounds of an iteration, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local master may go without, with a folder of its own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if not named and not current.isDefined():
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="vigil-"))
        current = sc._jsc.sc().getCheckpointDir()
    return named or current.get()


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again; gone when the session ends, or by drop()."""
    spark = df.sparkSession
    path = f"{_shared(spark).rstrip('/')}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, p = _files(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._vigil_round = path
    return out


def parts(df: DataFrame, rows: int) -> int:
    """Partitions for tasks of about ``rows`` rows each, as many as there are cores at least: the number grows with the table, not the tasks."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote, once nothing reads them any more."""
    for df in tables:
        if path := getattr(df, "_vigil_round", None):
            fs, p = _files(df.sparkSession, path)
            fs.delete(p, True)
