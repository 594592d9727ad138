"""Folder scans as a stream: new files become records once. Changed and removed files are for the batch re-scan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docloom.options import ReadOptions, Recursion
from docloom.sources import folder

_FILE = "path string, modificationTime timestamp, length long, content binary"


def record_stream(spark: SparkSession, root: str, options: ReadOptions | None = None) -> DataFrame:
    options = options or ReadOptions()
    nested = str(options.recursion is Recursion.ALL_NESTED).lower()
    files = spark.readStream.format("binaryFile").schema(_FILE).option("recursiveFileLookup", nested)
    if options.max_files > 0:
        files = files.option("maxFilesPerTrigger", options.max_files)
    files = files.load(folder.checked_root(root)).withColumnsRenamed({"length": "size_bytes", "modificationTime": "modified"})
    files = folder._filtered(folder._described(files), options)
    return folder.extracted(files, options)


def run_available(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Takes all files that are there, hands each batch to sink, and ends. The checkpoint remembers what was taken."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
