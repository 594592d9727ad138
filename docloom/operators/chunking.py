"""Splitting texts into overlapping pieces for retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.options import ChunkOptions

_COLUMNS = ("path", "name", "type_bucket", "metadata")


def starts(text: Column, options: ChunkOptions) -> Column:
    """0, step, 2 * step and so on; the first piece that reaches the end is the last."""
    n, step, most = F.length(text), options.step, options.max_chars
    n_more = F.ceil(F.greatest(n - most, F.lit(0)) / F.lit(step)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n_more), lambda k: k * F.lit(step))).otherwise(F.array().cast("array<int>"))


def piece(text: Column, start: Column, options: ChunkOptions) -> Column:
    """The text of a piece. One that does not reach the end is cut behind its last white space, if it stays at least a step long."""
    window = F.substring(text, start + 1, F.lit(options.max_chars))
    if not options.respect_word_boundaries:
        return window
    head = F.regexp_extract(window, r"(?Us)^(.+\s)", 1)
    inside = (start + F.lit(options.max_chars)) < F.length(text)
    return F.when(inside & (F.length(head) >= options.step), head).otherwise(window)


def chunked(records: DataFrame, options: ChunkOptions | None = None, *, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """A row for each piece: the kept columns, index, count, start_offset and text. Empty texts give none."""
    options = options or ChunkOptions()
    keep = tuple(c for c in _COLUMNS if c in records.columns) if keep is None else keep
    held = records.select(*keep, F.col(text).alias("_text"), starts(F.col(text), options).alias("_starts"))
    rows = held.select(*keep, "_text", F.size("_starts").alias("count"), F.posexplode("_starts").alias("index", "start_offset"))
    return rows.select(*keep, "index", "count", "start_offset", piece(F.col("_text"), F.col("start_offset"), options).alias("text"))
