"""A folder of files as a table of records.

Files are listed without their contents (``listing``); a file is then read once, and only if
some extractor takes it, or it is to be hashed, and it is within the size limit. Streams,
whose files Spark itself lists and loads, are made records by ``extracted``.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import paths
from docloom.functions.text import clipped, is_clipped, normalized
from docloom.operators.redaction.udf import redact_records
from docloom.operators.redaction import Redactor
from docloom.options import Level, ReadOptions, Recursion
from docloom.schema import RECORD
from docloom.sources import formats, listing as listed


def checked_root(root: str) -> str:
    """Raises for a local folder that does not exist; roots with a scheme are left to Spark."""
    local = root.removeprefix("file://")
    if "://" not in local and not os.path.isdir(local):
        raise FileNotFoundError(f"no such folder: {root}")
    return root


def _described(files: DataFrame) -> DataFrame:
    path = paths.without_scheme(F.col("path"))
    return files.select(
        path.alias("path"), paths.name(path).alias("name"), paths.extension(path).alias("extension"), paths.folder(path).alias("folder"),
        *[F.col(c) for c in files.columns if c != "path"],
    )


def _filtered(files: DataFrame, options: ReadOptions) -> DataFrame:
    if options.include_extensions:
        files = files.where(F.col("extension").isin(*sorted(options.include_extensions)))
    if options.exclude_paths:
        files = files.where(~F.col("path").isin(*sorted(os.path.abspath(p) for p in options.exclude_paths)))
    return files


def listing(spark: SparkSession, root: str, options: ReadOptions | None = None, *, limited: bool = True) -> DataFrame:
    """path, name, extension, folder, size_bytes, modified and stat_failed of each file; contents stay where they are."""
    options = options or ReadOptions()
    files = listed.files(spark, checked_root(root), options.recursion is Recursion.ALL_NESTED)
    files = _filtered(_described(files), options)
    return files.orderBy("path").limit(options.max_files) if limited and options.max_files > 0 else files


def _extractors(options: ReadOptions) -> tuple:
    return (*options.extractors, *formats.DEFAULT, *formats.ADDED)


def _readable(extension: Column, options: ReadOptions) -> Column:
    """Whether an extractor takes the extension. Those of the caller's are asked in the workers."""
    if options.extractors:
        return F.lit(True)
    known = [x for x in paths.BUCKETS if formats.chosen(x) is not None]
    return F.lower(extension).isin(*known)


_EXTRACTED = "path string, size_bytes long, modified timestamp, hash string, metadata map<string,string>, text string, problems array<string>"
_NAMES = ["path", "size_bytes", "modified", "hash", "metadata", "text", "problems"]
#: Texts that a reading task hands on at once: about so many characters, or so many files.
BATCH_CHARS, BATCH_FILES = 4_000_000, 1000


def _extract(options: ReadOptions):
    extractors, hashed = _extractors(options), options.content_hash

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            out = []
            for path, ext, data in zip(files["path"], files["extension"], files["content"]):
                metadata, text, problem = {}, "", None
                taker = next((e for e in extractors if e.can_handle(ext)), None)
                if taker is not None and data is not None:
                    try:
                        found = taker.extract(path.rsplit("/", 1)[-1], bytes(data))
                        metadata, text = dict(found[0]), found[1] or ""
                    except Exception as e:  # one bad file must not end the job; the row says what happened
                        problem = f"extract-failed: {type(e).__name__}"
                out.append((metadata, text, [problem] if problem else []))
            kept = files[["path", "size_bytes", "modified", "hash"]].copy()
            kept["metadata"], kept["text"], kept["problems"] = [o[0] for o in out], [o[1] for o in out], [o[2] for o in out]
            yield kept

    return run


def _open(options: ReadOptions):
    """Reads the files of a listing, each at most once, and extracts them."""
    extractors, hashed, limit = _extractors(options), options.content_hash, options.max_bytes_per_file

    def one(read, path: str, ext: str, size: int, stat_failed: bool) -> tuple:
        problems = ["stat-failed"] if stat_failed else []
        taker = next((e for e in extractors if e.can_handle(ext)), None)
        metadata, text, code = {}, "", None
        if limit > 0 and size > limit:
            return code, metadata, text, problems + ([f"skipped-content: {size} bytes over limit"] if taker is not None else [])
        if taker is None and not hashed:
            return code, metadata, text, problems
        try:
            data = read(path)
        except Exception as e:  # a file that cannot be read has a row that says so
            return code, metadata, text, problems + ["hash-failed"] * hashed + ([f"extract-failed: {type(e).__name__}"] if taker is not None else [])
        if hashed:
            code = hashlib.sha256(data).hexdigest()
        if taker is not None:
            try:
                found = taker.extract(path.rsplit("/", 1)[-1], data)
                metadata, text = dict(found[0]), (found[1] or "").encode("utf-8", "replace").decode()
            except Exception as e:  # one bad file must not end the job
                problems.append(f"extract-failed: {type(e).__name__}")
        return code, metadata, text, problems

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        path, size, modified, code, metadata, text, problems = zip(*rows)
        return pa.RecordBatch.from_arrays([
            pa.array(path, pa.string()), pa.array(size, pa.int64()), pa.array(modified, pa.timestamp("us", "UTC")), pa.array(code, pa.string()),
            pa.array([list(m.items()) for m in metadata], pa.map_(pa.string(), pa.string())), pa.array(text, pa.string()), pa.array(problems, pa.list_(pa.string())),
        ], names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, rows, chars = listed.opener(), [], 0
        for files in batches:
            modified = files.column("modified").cast(pa.int64()).to_pylist()
            for path, ext, size, time, failed in zip(*(files.column(c).to_pylist() for c in ("path", "extension", "size_bytes")), modified, files.column("stat_failed").to_pylist()):
                code, metadata, text, problems = one(read, path, ext, size, failed)
                rows.append((path, size, time, code, metadata, text, problems))
                chars += len(text)
                if chars >= BATCH_CHARS or len(rows) >= BATCH_FILES:
                    yield batch(rows)
                    rows, chars = [], 0
        if rows:
            yield batch(rows)

    return run


def opened(files: DataFrame, options: ReadOptions, tasks: int | None = None) -> DataFrame:
    """Records of a listing. Files are shared out evenly among the tasks, however they lie in folders."""
    spark = files.sparkSession
    tasks = tasks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    files = files.select("path", "extension", "size_bytes", "modified", "stat_failed").repartition(tasks)
    return finished(files.mapInArrow(_open(options), _EXTRACTED), options)


def finished(rows: DataFrame, options: ReadOptions) -> DataFrame:
    """Records of rows with path, size_bytes, modified, hash, metadata, raw text and problems: text is normalized, clipped and then redacted."""
    text = normalized(F.coalesce(F.col("text"), F.lit("")))
    warnings = F.concat("problems", F.array_compact(F.array(F.when(is_clipped(F.col("_full"), options.max_text_length), F.lit("text-clipped")))))
    rows = rows.withColumn("_full", text).withColumn("warnings", warnings).withColumn("text", clipped(F.col("_full"), options.max_text_length))
    ext = paths.extension(F.col("path"))
    rows = rows.select(
        "path", paths.name(F.col("path")).alias("name"), ext.alias("extension"), paths.folder(F.col("path")).alias("folder"), "size_bytes", "modified",
        paths.type_bucket(ext).alias("type_bucket"), F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"), "text",
        F.create_map().cast("map<string,int>").alias("redactions"), "warnings", F.col("hash").alias("content_hash"),
    )
    redactor = options.redactor or (Redactor(options.redaction) if options.redaction is not Level.OFF else None)
    return redact_records(rows, redactor) if redactor is not None else rows


def _marked(content: Column) -> Column:
    """Whether a byte order mark comes first; such texts are decoded by the extractor."""
    first = F.hex(F.substring(content, 1, 4))
    return first.startswith("EFBBBF") | first.startswith("FFFE") | first.startswith("FEFF") | first.startswith("0000FEFF")


def extracted(files: DataFrame, options: ReadOptions) -> DataFrame:
    """Records of described files with their content, as streams have them."""
    limit = options.max_bytes_per_file
    fits = F.lit(True) if limit <= 0 else F.col("size_bytes") <= limit
    readable = _readable(F.col("extension"), options)
    wanted = fits & (readable | F.lit(options.content_hash))
    hashed = F.sha2("content", 256) if options.content_hash else F.lit(None).cast("string")
    read = files.where(wanted).select("path", "extension", "size_bytes", "modified", hashed.alias("hash"), "content")
    simple = F.lit(False) if options.extractors else F.col("extension").isin(*sorted(formats.PlainText.extensions)) & ~_marked(F.col("content"))
    done = read.where(~simple).mapInPandas(_extract(options), _EXTRACTED)
    none = F.create_map().cast("map<string,string>").alias("metadata")
    decoded = F.make_valid_utf8(F.col("content").cast("string")).alias("text")
    quiet = F.array().cast("array<string>")
    note = F.concat(F.lit("skipped-content: "), F.col("size_bytes").cast("string"), F.lit(" bytes over limit"))
    problems = F.when(~fits & readable, F.array(note)).otherwise(quiet).alias("problems")
    plain = files.where(~wanted).select("path", "size_bytes", "modified", F.lit(None).cast("string").alias("hash"), none, F.lit("").alias("text"), problems)
    rows = done.unionByName(plain).unionByName(read.where(simple).select("path", "size_bytes", "modified", "hash", none, decoded, quiet.alias("problems")))
    return finished(rows, options)


def empty_records(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RECORD)


def read(spark: SparkSession, root: str, options: ReadOptions | None = None, *, tasks: int | None = None) -> DataFrame:
    """A record for each file under root. With a limit on their number, the first by path. tasks: how many read (None: options.parallelism, if it is more than 1, else as many as the session has)."""
    options = options or ReadOptions()
    return opened(listing(spark, root, options), options, tasks or (options.parallelism if options.parallelism > 1 else None))


def read_parallel(spark: SparkSession, root: str, options: ReadOptions) -> DataFrame:
    """As read, with the records made by as many tasks as options.parallelism says."""
    return read(spark, root, options, tasks=options.parallelism)
