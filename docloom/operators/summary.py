"""Totals of a run and the events of its files."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def n_redacted(redactions: Column) -> Column:
    return F.aggregate(F.coalesce(F.map_values(redactions), F.array().cast("array<int>")), F.lit(0).cast("long"), lambda t, n: t + n)


def has_sensitive(redactions: Column) -> Column:
    return F.coalesce(F.size(redactions) > 0, F.lit(False))


def run_summary(records: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """One row: files, values redacted, files with warnings, files removed."""
    out = records.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum(n_redacted(F.col("redactions"))), F.lit(0)).alias("redacted"),
        F.count_if(F.coalesce(F.size("warnings"), F.lit(0)) > 0).alias("with_warnings"),
    )
    gone = removed.agg(F.count("*").alias("removed")) if removed is not None else None
    return out.crossJoin(gone) if gone is not None else out.withColumn("removed", F.lit(0).cast("long"))  # one row each


def counts_by_category(records: DataFrame) -> DataFrame:
    return records.select(F.explode("redactions").alias("category", "n")).groupBy("category").agg(F.sum("n").alias("n_values"), F.count("*").alias("n_files"))


def leak_gate(records: DataFrame) -> DataFrame:
    """One row: whether any value was redacted, for a build that must fail then."""
    return run_summary(records).select("redacted", (F.col("redacted") > 0).alias("failed"))


def diagnostics(records: DataFrame, unchanged: DataFrame | None = None) -> DataFrame:
    """path, ordinal, event, message, is_warning: each warning, then ``read`` unless the content could not be had; ``unchanged`` for carried files."""
    code = lambda w: F.substring_index(w, ":", 1)
    warned = F.transform(F.col("warnings"), lambda w: F.struct(code(w).alias("event"), w.alias("message"), F.lit(True).alias("is_warning")))
    stopped = F.exists("warnings", lambda w: code(w).isin("skipped-content", "extract-failed", "stat-failed"))
    said = F.concat(F.col("type_bucket"), F.lit(", "), F.length("text").cast("string"), F.lit(" chars"))
    read = F.when(stopped, F.array()).otherwise(F.array(F.struct(F.lit("read").alias("event"), said.alias("message"), F.lit(False).alias("is_warning"))))
    rows = records.select("path", F.posexplode(F.concat(warned, read.cast("array<struct<event:string,message:string,is_warning:boolean>>"))).alias("ordinal", "e"))
    out = rows.select("path", "ordinal", "e.event", "e.message", "e.is_warning")
    if unchanged is not None:
        out = out.unionByName(unchanged.select("path", F.lit(0).alias("ordinal"), F.lit("unchanged").alias("event"), F.lit("as in the manifest").alias("message"), F.lit(False).alias("is_warning")))
    return out


def log(events: DataFrame, logger: logging.Logger | None = None, sink: Callable[[Row], None] | None = None) -> None:
    """Hands events to a callback or, without one, to a logger: warnings as such, others for debugging. Streams one partition at a time."""
    logger = logger or logging.getLogger("docloom")
    for e in events.toLocalIterator():
        if sink is not None:
            sink(e)
        else:
            logger.log(logging.WARNING if e["is_warning"] else logging.DEBUG, "%s: %s (%s)", e["path"], e["event"], e["message"])
