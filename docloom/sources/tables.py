"""Tables of texts in the shape of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import paths, text

#: The time that rows of tables without one are given.
FIXED_TIME = "2026-01-02 03:04:05"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _records(df: DataFrame, path: Column, raw: Column, body: Column, metadata: Column, *more: str) -> DataFrame:
    ext = paths.extension(F.col("path"))
    held = df.select(path.alias("path"), F.octet_length(F.coalesce(raw, F.lit(""))).cast("long").alias("size_bytes"), metadata.alias("metadata"), body.alias("text"), *more)
    return held.select(
        "path", paths.name(F.col("path")).alias("name"), ext.alias("extension"), paths.folder(F.col("path")).alias("folder"), "size_bytes",
        F.lit(FIXED_TIME).cast("timestamp").alias("modified"), paths.type_bucket(ext).alias("type_bucket"), "metadata", "text",
        F.create_map().cast("map<string,int>").alias("redactions"), F.array().cast("array<string>").alias("warnings"), F.lit(None).cast("string").alias("content_hash"), *more,
    )


def documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    path = F.concat_ws("", F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    meta = F.create_map(F.lit("lang"), F.coalesce("lang", F.lit("")), F.lit("source"), F.coalesce("source", F.lit("")))
    return _records(table(spark, sf_dir, "documents"), path, F.col("text"), F.coalesce("text", F.lit("")), meta, *more)


def pages(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    path = F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html"))
    title = text.html_title(F.col("html"))
    meta = F.when(title.isNull(), F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("Title"), title))
    return _records(table(spark, sf_dir, "pages"), path, F.col("html"), text.html_text(F.coalesce("html", F.lit(""))), meta, *more)


def conversations(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    path = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit(".txt"))
    return _records(table(spark, sf_dir, "conversations"), path, F.col("text"), F.coalesce("text", F.lit("")), F.create_map(F.lit("role"), F.coalesce("role", F.lit(""))), *more)
