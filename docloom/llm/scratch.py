"""Tables written once and read again, in the folder that all executors share.

A written table cuts the lineage without keeping a copy on a single executor, so a
lost executor costs only the tasks that it was running. They lie in the folder of
spark.checkpoint.dir; a session on a cluster must name one, and a local one without it gets a
temporary folder. ``temporary`` drops what was written within it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, a new one for this session if it is local, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = known.get() if known.isDefined() else None
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: The paths of each open ``temporary``.
_made: list[list[str]] = []


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    return path


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """What is written within, to paths that ``new_path`` gave there, is dropped at the end: no plan may read it after that."""
    _made.append([])
    try:
        yield
    finally:
        drop(spark, *_made.pop())


def written(df: DataFrame, label: str) -> DataFrame:
    """df, computed once: written as Parquet to the shared folder and read from there."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes tables or files of the shared folder that no plan reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
