"""From raw documents to packed sequences: quality, toxicity, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but the last return the
columns of documents. The stages are written as Parquet and read again by run().

Defined cases, for every stage: null text is the empty text; empty texts are judged as such (the classifiers score them,
the dedup stages keep them, packing gives them one piece); texts of any length are taken whole; a null doc_id stays and is
in no group; rows that repeat a doc_id are separate documents; ties are broken by doc_id, then by the text's hash; further
columns pass through the first three stages, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import common, minhash, packing, quality, substring, toxicity


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels of what it is given, does not reject."""
    return quality.keep(docs, quality.fit(docs, common.table(spark, sf_dir, "labels")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    return toxicity.keep(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five-word shingles, likeness of 0.8 or more): that of the least doc_id."""
    return minhash.dedup(docs, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated paragraphs; n_chars follows the text. A document of which nothing is left goes.

    Columns that bear the names of the report's are not lost: the five columns of documents are what comes and goes.
    """
    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    out = substring.dedup(own, report=True).where("n_removed = 0 or trim(text) <> ''")
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(own.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [("quality classifier", keep_quality), ("toxicity", drop_toxic), ("near-dedup", near_dedup), ("substring dedup", substring_dedup), ("packing", pack)]

#: SQL can express neither the classifiers nor the tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.cut(stage(spark, docs, sf_dir))
    return docs
