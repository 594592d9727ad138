"""The entry point: scan, re-scan, chunk and import with one set of options."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from docloom.operators import incremental, summary
from docloom.operators.chunking import chunked
from docloom.options import ChunkOptions, ReadOptions
from docloom.plans import sinks
from docloom.sources import folder, manifest

_engines: dict[tuple, "Engine"] = {}


class Rescan(NamedTuple):
    changed: DataFrame
    removed: DataFrame
    manifest: DataFrame
    unchanged: DataFrame


class Engine:
    def __init__(self, spark: SparkSession, options: ReadOptions | None = None) -> None:
        self.spark, self.options = spark, options or ReadOptions()

    @classmethod
    def get_or_create(cls, spark: SparkSession, configure: Callable[[SparkSession], ReadOptions] | ReadOptions | None = None) -> Engine:
        """One engine a session: the first options stay."""
        key = (spark.sparkContext.applicationId,)
        if key not in _engines:
            _engines[key] = cls(spark, configure(spark) if callable(configure) else configure)
        return _engines[key]

    def read(self, root: str) -> DataFrame:
        return folder.read(self.spark, root, self.options)

    def read_stream(self, root: str) -> Iterator[Row]:
        """The rows one by one, in order of path, without all of them at once on the driver."""
        return self.read(root).orderBy("path").toLocalIterator(prefetchPartitions=self.options.parallelism > 1)

    def read_changes(self, root: str, baseline: DataFrame) -> Rescan:
        """Contents are read only of files that are new or differ; the limit on the number of files does not count here."""
        if baseline is None:
            raise ValueError("a baseline manifest is needed")
        files = folder.listing(self.spark, root, self.options, limited=False)
        found = incremental.compared(files, baseline)
        whole = folder.opened(files.join(found.changed.select("path"), "path", "left_semi"), self.options)
        return Rescan(whole, found.removed, incremental.merged(found.unchanged, whole), found.unchanged)

    def diagnostics(self, records: DataFrame, unchanged: DataFrame | None = None) -> DataFrame:
        return summary.diagnostics(records, unchanged)

    def chunks(self, root: str, options: ChunkOptions | None = None) -> DataFrame:
        return chunked(self.read(root), options)

    def import_folder(self, root: str, save: Callable[[list[Row]], None], options: ChunkOptions | None = None, mapper: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Scans, chunks and hands the pieces to a store; files without text give none."""
        sinks.upsert(self.chunks(root, options), save, mapper=mapper or sinks.memory_rows)

    def new_manifest(self, records: DataFrame) -> DataFrame:
        return incremental.deduplicated(incremental.entries_of(records), F.lit(0))

    def empty_manifest(self) -> DataFrame:
        return manifest.empty(self.spark)
