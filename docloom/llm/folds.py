"""Labelled rows for training: bounded samples that depend on ids alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import scratch


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id is in no fold."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def sampled(docs: DataFrame, labels: DataFrame, label_col: str, *, folds: int, held_out: int, per_label: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, float]]:
    """text and label of at most per_label rows of each label outside the held-out fold, and each label's weight.

    The rows are those with the least hashes of their ids. A weight says how many labelled
    rows one row of the sample stands for. Ids with contradicting labels are left out.
    """
    own = labels.select(F.col("doc_id").alias("_id"), (F.col(label_col) > 0).cast("int").alias("label")).where("label is not null and _id is not null")
    own = own.where(remainder(F.col("_id"), folds) != held_out).groupBy("_id").agg(F.min("label").alias("label"), F.max("label").alias("_top"))
    own = scratch.written(own.where("label = _top").select("_id", "label"), "train-labels")
    total = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}  # two rows
    order = [F.xxhash64("_id"), F.col("_id")]
    parts = [own.where(F.col("label") == k).orderBy(*order).limit(per_label) for k in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 * per_label ids
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    texts = texts.join(chosen, "_id").dropDuplicates(["_id"])
    return texts, {k: n / min(n, per_label) for k, n in total.items()}


def unlabelled(docs: DataFrame, labels: DataFrame, label_col: str, *, folds: int, held_out: int, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, text and label (null) of at most so many rows outside the held-out fold that have no label: those with the least hashes of their ids."""
    known = labels.where(F.col(label_col).isNotNull()).select(F.col("doc_id").alias("_id")).distinct()
    ids = docs.select(F.col(f"`{id_col}`").alias("_id")).where(remainder(F.col("_id"), folds) != held_out)
    ids = ids.join(known, "_id", "left_anti").orderBy(F.xxhash64("_id"), F.col("_id")).limit(most)
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(scratch.written(ids.distinct(), "train-free")), "_id").dropDuplicates(["_id"])  # at most `most` ids
    return texts.withColumn("label", F.lit(None).cast("int"))
