"""Files of a folder without their contents, listed where the tasks run.

The driver walks the upper folders only, until there are enough to share out; each task
walks its own down to the leaves. All names count, those that begin with a dot or an
underscore and empty files, too. Local paths go through the operating system, those with
another scheme through Arrow's file systems.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: The driver stops sharing out when it has so many folders.
ENOUGH = 64
#: Rows of a batch of paths.
ROWS = 4096
FILE = "path string, size_bytes long, modified timestamp, stat_failed boolean"
_NAMES = ["path", "size_bytes", "modified", "stat_failed"]
#: The time of a file whose time cannot be had, in microseconds: the third day of year 1, the first that can be shown in all time zones.
_NEVER = -62_135_424_000_000_000


def is_local(root: str) -> bool:
    return "://" not in root or root.startswith("file:")


def local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


def _remote(uri: str) -> tuple[fs.FileSystem, str, str]:
    """The file system, the path in it, and what goes before a path of it to make a URI again."""
    where, path = fs.FileSystem.from_uri(uri)
    return where, path, uri[: uri.index(path)] if path in uri else uri.split("://")[0] + "://"


def _entries(folder: str) -> tuple[list[tuple], list[str]]:
    """Files (path, size, microseconds, whether they could not be asked for these) and folders of one folder. What cannot be listed is empty."""
    files, folders = [], []
    if not is_local(folder):
        where, path, before = _remote(folder)
        for info in where.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if info.type == fs.FileType.Directory:
                folders.append(before + info.path)
            else:
                files.append((before + info.path, info.size or 0, _NEVER if info.mtime_ns is None else info.mtime_ns // 1000, info.size is None))
        return files, folders
    try:
        with os.scandir(folder) as found:
            for entry in found:
                try:
                    if entry.is_dir():
                        if not entry.is_symlink() or not os.path.realpath(folder).startswith(os.path.realpath(entry.path)):
                            folders.append(entry.path)
                        continue
                    stat = entry.stat()
                    files.append((entry.path, stat.st_size, stat.st_mtime_ns // 1000, False))
                except OSError:
                    files.append((entry.path, 0, _NEVER, True))
    except OSError:
        pass
    return files, folders


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    path, size, modified, failed = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(size, pa.int64()), pa.array(modified, pa.timestamp("us", "UTC")), pa.array(failed, pa.bool_())], names=_NAMES)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for batch in batches:
        for top, deep in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            left = [top]
            while left:
                files, folders = _entries(left.pop())
                held += files
                if deep:
                    left += folders
                while len(held) >= ROWS:
                    yield _batch(held[:ROWS])
                    held = held[ROWS:]
    if held:
        yield _batch(held)


def files(spark: SparkSession, root: str, nested: bool) -> DataFrame:
    """FILE of all files under root, in no order."""
    root = os.path.abspath(local(root)) if is_local(root) else root.rstrip("/")
    shallow: list[str] = []
    deep = deque([root])
    while nested and deep and len(deep) < ENOUGH and len(shallow) < ENOUGH:
        folders = _entries(deep[0])[1]
        shallow.append(deep.popleft())
        deep.extend(folders)
    if not nested:
        shallow, deep = [root], deque()
    units = pa.table({"folder": pa.array([*shallow, *deep], pa.string()), "deep": pa.array([False] * len(shallow) + [True] * len(deep), pa.bool_())})
    return spark.createDataFrame(units).mapInArrow(_walk, FILE)


def opener() -> Callable[[str], bytes]:
    """Reads a whole file by its path in a listing."""
    known: dict[str, fs.FileSystem] = {}

    def read(path: str) -> bytes:
        if is_local(path):
            with open(local(path), "rb") as file:
                return file.read()
        scheme = path[: path.index("/", path.index("://") + 3)]
        if scheme not in known:
            known[scheme] = _remote(path)[0]
        with known[scheme].open_input_stream(_remote(path)[1]) as file:
            return file.read()

    return read
