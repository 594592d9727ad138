"""The queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import binary, convnet, folds, lines, mixing, neardup, neighbours, packing, revisits, rules, scratch, tokens, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_texts(_table(spark, sf_dir, "documents"), tokens.path("word_bpe_49k.json")).drop("ids")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.cleaned(docs).select("row.doc_id", "n_lines", "n_dropped", "kept_sha256")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.clustered(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    classifier, _ = toxicity.trained(docs, _table(spark, sf_dir, "labels"))
    out = toxicity.scored(docs, classifier)
    return out.select("doc_id", (folds.remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = revisits.resolved(revisits.captures(_table(spark, sf_dir, "pages")))
    headers = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return out.select("record_id", "url_key", "response_id", "status", F.array_join("checked", ",").alias("checked"), headers.alias("headers"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch.new_path(spark, "tokens")
    binary.write(_table(spark, sf_dir, "documents"), at, tokens.path("byte_bpe_50k.json"))
    return binary.read(spark, at)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = convnet.scored(docs, convnet.trained(docs, _table(spark, sf_dir, "labels")))
    return out.select("row.doc_id", (folds.remainder(F.col("row.doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_pack_sequences, op3_line_dedup, op4_near_dedup, op5_toxicity,
        op6_warc_revisits, op7_nearest, op8_quality_rules, op9_token_binary, op10_quality_classifier,
    )
}
