"""What changed since a manifest: one row a file, keyed by path."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ENTRY = ("path", "size_bytes", "modified", "content_hash")


class Changes(NamedTuple):
    """changed: listing rows that are new or differ; unchanged: the baseline's rows as they were; removed: paths that are gone."""

    changed: DataFrame
    unchanged: DataFrame
    removed: DataFrame


def deduplicated(entries: DataFrame, order: Column) -> DataFrame:
    """The last entry of each path in the given order."""
    row = F.struct(*_ENTRY)
    return entries.groupBy("path").agg(F.max_by(row, order).alias("_r")).select("_r.*")


def entries_of(records: DataFrame) -> DataFrame:
    """Manifest rows of records."""
    columns = [F.col(c) if c in records.columns else F.lit(None).cast("string").alias(c) for c in _ENTRY]
    return records.select(*columns)


def compared(listing: DataFrame, baseline: DataFrame) -> Changes:
    """Size and time decide, not content; a file whose size or time could not be read counts as changed."""
    if baseline is None:
        raise ValueError("a baseline manifest is needed; an empty one is made by manifest.empty")
    old = baseline.select(F.col("path"), *[F.col(c).alias(f"_{c}") for c in _ENTRY[1:]], F.lit(True).alias("_known"))
    met = listing.join(old, "path", "left")
    same = F.coalesce(F.col("_known") & (F.col("size_bytes") == F.col("_size_bytes")) & (F.col("modified") == F.col("_modified")), F.lit(False))
    changed = met.where(~same).select(*listing.columns)
    unchanged = met.where(same).select("path", *[F.col(f"_{c}").alias(c) for c in _ENTRY[1:]])
    removed = baseline.join(listing.select("path"), "path", "left_anti").select("path")
    return Changes(changed, unchanged, removed)


def merged(unchanged: DataFrame, changed: DataFrame) -> DataFrame:
    """The next manifest: carried rows under new ones."""
    both = unchanged.select(*_ENTRY, F.lit(0).alias("_new")).unionByName(entries_of(changed).select("*", F.lit(1).alias("_new")))
    return deduplicated(both, F.col("_new"))
