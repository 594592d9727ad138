"""A manifest of files as a text table: a header line, then size, ticks, hash and path by tabs, in order of path.

A tick is 100 nanoseconds since year 1. Times are kept to the microsecond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.incremental import deduplicated
from docloom.schema import MANIFEST

HEADER = "# docloom-manifest v1"
_EPOCH = 621_355_968_000_000_000
_LAST = 3_155_378_975_999_999_999


def ticks(ts: Column) -> Column:
    return F.unix_micros(ts) * 10 + F.lit(_EPOCH)


def from_ticks(value: Column) -> Column:
    return F.timestamp_micros(F.floor((value - F.lit(_EPOCH)) / F.lit(10)).cast("long"))


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], MANIFEST)


def lines(entries: DataFrame) -> DataFrame:
    """path and line of each entry, without the header."""
    line = F.concat_ws("\t", F.col("size_bytes").cast("string"), ticks(F.col("modified")).cast("string"), F.coalesce("content_hash", F.lit("")), F.col("path"))
    return entries.select("path", line.alias("line"))


def parsed(text_lines: DataFrame, column: str = "value") -> DataFrame:
    """Entries of lines. Blank lines, comments, lines without four fields and those whose numbers cannot be read are left out; of equal paths the last stays."""
    value = F.regexp_replace(F.col(column), "\r$", "")
    cut = F.split(value, "\t", 4)
    spark_safe = text_lines.select(value.alias("v"), F.monotonically_increasing_id().alias("_at"), cut.alias("f"))
    good = spark_safe.where((F.trim("v") != "") & ~F.col("v").startswith("#") & (F.size("f") == 4))
    size, tick = F.expr("try_cast(f[0] as bigint)"), F.expr("try_cast(f[1] as bigint)")
    good = good.select("_at", F.col("f")[3].alias("path"), size.alias("size_bytes"), tick.alias("_t"), F.nullif(F.col("f")[2], F.lit("")).alias("content_hash"))
    good = good.where(F.col("size_bytes").isNotNull() & F.col("_t").between(0, _LAST))
    return deduplicated(good.select("path", "size_bytes", from_ticks(F.col("_t")).alias("modified"), "content_hash", "_at"), F.col("_at"))


def load(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark.read.text(path))


def save(entries: DataFrame, path: str) -> None:
    """A folder of text parts in order of path, the header in the first; written over what is there."""
    spark = entries.sparkSession
    head = spark.createDataFrame([(HEADER,)], "line string").coalesce(1)
    body = lines(deduplicated(entries, F.lit(0))).orderBy("path").select("line")
    head.union(body).write.mode("overwrite").text(path, lineSep="\n")


def save_file(entries: DataFrame, path: str) -> None:
    """One text file on the driver's disk, written row by row."""
    with open(path, "w", encoding="utf-8", newline="") as out:
        out.write(HEADER + "\n")
        for row in lines(deduplicated(entries, F.lit(0))).orderBy("path").toLocalIterator():
            out.write(row["line"] + "\n")
