"""Records and chunks as CSV, JSON, JSON Lines and Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from docloom.functions.text import iso_local, iso_utc

#: Columns of a flat record and what they are called in CSV and Parquet.
FLAT = (
    ("path", "Path"), ("name", "Name"), ("extension", "Extension"), ("folder", "Folder"), ("size_bytes", "SizeBytes"), ("modified", "Modified"),
    ("type_bucket", "TypeBucket"), ("text", "Text"), ("warnings", "Warnings"), ("redactions", "Redactions"), ("content_hash", "ContentHash"),
)
CSV_HEADER = ",".join(name for _, name in FLAT)


def joined_pairs(counts: Column) -> Column:
    return F.array_join(F.transform(F.map_entries(F.coalesce(counts, F.create_map().cast("map<string,int>"))), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ";")


def flat(records: DataFrame) -> DataFrame:
    """Scalars only: lists and counts become strings, the time stays a time."""
    special = {"warnings": F.array_join(F.coalesce("warnings", F.array().cast("array<string>")), ";"), "redactions": joined_pairs(F.col("redactions"))}
    return records.select(*[special.get(c, F.col(c)).alias(name) for c, name in FLAT])


def csv_field(value: Column) -> Column:
    """Quoted only if it must be."""
    value = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(value.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def _time(ts: Column, utc: bool, zone: str | None) -> Column:
    return iso_utc(ts) if utc else iso_local(ts, zone)


def csv_rows(records: DataFrame, *, utc: bool = True, zone: str | None = None) -> DataFrame:
    rows = flat(records).withColumn("Modified", _time(F.col("Modified"), utc, zone))
    return rows.select("Path", F.concat_ws(",", *[csv_field(F.col(name)) for _, name in FLAT]).alias("value"))


def _json(row: Column) -> Column:
    """Control characters are escaped in lower-case hexadecimal."""
    text = F.to_json(row, {"ignoreNullFields": "false"})
    codes = [c for c in range(32) if f"{c:04x}" != f"{c:04X}" and c not in (8, 9, 10, 12, 13)]
    for c in codes:
        text = F.replace(text, F.lit(f"\\u{c:04X}"), F.lit(f"\\u{c:04x}"))
    return text


def record_json(records: DataFrame, *, utc: bool = True, zone: str | None = None) -> DataFrame:
    """path and value: an object of twelve keys for each record."""
    row = F.struct(
        "path", "name", "extension", "folder", F.col("size_bytes").alias("sizeBytes"), _time(F.col("modified"), utc, zone).alias("modified"), F.col("type_bucket").alias("typeBucket"),
        "metadata", "text", "redactions", "warnings", F.col("content_hash").alias("contentHash"),
    )
    return records.select("path", _json(row).alias("value"))


def chunk_json(chunks: DataFrame) -> DataFrame:
    row = F.struct("path", "name", F.col("type_bucket").alias("typeBucket"), "index", "count", F.col("start_offset").alias("startOffset"), "text", "metadata")
    return chunks.select("path", "index", _json(row).alias("value"))


def memory_rows(chunks: DataFrame) -> DataFrame:
    """chunk_id, text, description and metadata_json of each piece, for a semantic memory."""
    return chunks.select(
        F.concat("path", F.lit("#chunk"), F.col("index").cast("string")).alias("chunk_id"), "text", F.col("name").alias("description"), _json(F.col("metadata")).alias("metadata_json"),
    )


def write_json_lines(rows: DataFrame, path: str, *order: str) -> None:
    rows.orderBy(*order).select("value").write.mode("overwrite").text(path, lineSep="\n")


def write_csv(records: DataFrame, path: str, *, utc: bool = True, zone: str | None = None) -> None:
    """A folder of parts in order of path, the header in the first."""
    head = records.sparkSession.createDataFrame([(CSV_HEADER,)], "value string").coalesce(1)
    head.union(csv_rows(records, utc=utc, zone=zone).orderBy("Path").select("value")).write.mode("overwrite").text(path, lineSep="\r\n")


def write_parquet(records: DataFrame, path: str) -> None:
    flat(records).write.mode("overwrite").parquet(path)


def write_to(records: DataFrame, kind: str, out, *, utc: bool = True, zone: str | None = None) -> None:
    """All records to an open text file on the driver, one after the other in order of path."""
    if kind == "csv":
        out.write(CSV_HEADER + "\r\n")
        for r in csv_rows(records, utc=utc, zone=zone).orderBy("Path").toLocalIterator():
            out.write(r["value"] + "\r\n")
        return
    rows = record_json(records, utc=utc, zone=zone).orderBy("path").toLocalIterator()
    if kind == "json":
        out.write("[")
        for k, r in enumerate(rows):
            out.write("," * (k > 0) + r["value"])
        out.write("]")
        return
    for r in rows:
        out.write(r["value"] + "\n")


def upsert(rows: DataFrame, save: Callable[[list[Row]], None], *, batch: int = 500, mapper: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Hands rows, mapped first if wished, to a store from the tasks that hold them, in batches; an empty table makes no call."""
    rows = mapper(rows) if mapper is not None else rows

    def send(part) -> None:
        held: list[Row] = []
        for row in part:
            held.append(row)
            if len(held) == batch:
                save(held)
                held = []
        if held:
            save(held)

    rows.foreachPartition(send)
