"""From documents to packed training sequences: classify, drop shared lines, drop near copies, mix, pack.

``run`` writes each stage's rows as Parquet to the shared folder and reads them again as
the next stage's documents. All stages but the last return the columns of documents. What a
stage wrote for itself, and the rows that it read, are dropped when its own are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import convnet, lines, mixing, neardup, packing, scratch, tokens


#: Texts are sent to Python in batches of so many rows, as those that follow one another may all be long.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _short_batches(spark: SparkSession) -> None:
    """The rows of a stage are made after it returned, so the setting stays; ``run`` puts the caller's back."""
    spark.conf.set(_BATCH, BATCH_ROWS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the classifier says that their quality is 1; it learns from the labels outside its held-out fold."""
    _short_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = convnet.scored(docs, convnet.trained(docs, labels)).where("predicted = 1")
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share are gone from all texts; n_chars is counted again."""
    _short_batches(spark)
    out = lines.without_shared_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least id."""
    _short_batches(spark)
    return neardup.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids, and their places in sequences of 2048 ids."""
    _short_batches(spark)
    return packing.packed_texts(docs, tokens.path("word_bpe_49k.json"), remembered=200_000)


STAGES = [("quality classifier", quality), ("line dedup", line_dedup), ("near dedup", near_dedup), ("mix sources", mix), ("pack", pack)]

#: SQL cannot express a trained network; tests hold the stages against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before, batch = spark.read.parquet(f"{sf_dir}/documents.parquet"), None, spark.conf.get(_BATCH)
    try:
        for name, stage in STAGES:
            path = scratch.new_path(spark, "pipeline-" + name.replace(" ", "-"))
            with scratch.temporary(spark):
                rows = stage(spark, docs, sf_dir)
                rows.write.parquet(path)
            docs = spark.read.schema(rows.schema).parquet(path)
            if before:
                scratch.drop(spark, before)
            before = path
    finally:
        spark.conf.set(_BATCH, batch)
    return docs
