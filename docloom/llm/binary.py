"""Token ids of a corpus as binary shards whose document boundaries are Elias-Fano encoded.

A shard holds the ids of its documents one after the other and, behind them, the n + 1
boundaries between documents: of each boundary the low bits as they are and the high bits
in unary, with the place of every 256th set bit. Boundary i is found by a select on the
high bits; a document costs about 2 bits and the low bits instead of a 64-bit number.
Document ids ascend and are encoded alike.

Layout: ids | low bits | high bits | select samples | the same three for document ids |
footer (JSON) | its length (4 bytes) | ``DLOOMTK1``. Numbers are little-endian; an id has
2 bytes if the vocabulary's highest id allows it, else 4, and one that does not fit raises.
The shards are in order of doc_id, and ``manifest.json`` has the number of ids before each.

Defined results: a null or empty text is the end id alone; a very long text is one document
of one shard; a null doc_id is before all others; rows that share an id are in order of
their texts, and each is a document; an empty corpus has a manifest without shards. Other
columns are ignored. Strings of special tokens in a text are ordinary text, as the files'
own README has it, unless special_as_text is false.

Data sizes: texts are shuffled once, by ranges of doc_id, and each task writes its range as
shards of at most SHARD_IDS ids or SHARD_DOCS documents (a longer text alone excepted), one
after the other, each under a name of its own attempt that is then renamed; a task that runs
again writes the same shards. Readers hold the boundaries of one shard and the ids of a
block of its documents, whose ends they find by select. The driver gets one row a shard.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import scratch, tokens

MAGIC = b"DLOOMTK1"
SAMPLE = 256
#: A shard ends at so many ids or documents; a reader takes blocks of so many documents and about so many ids.
SHARD_IDS, SHARD_DOCS = 1 << 26, 1 << 20
BLOCK_DOCS, BLOCK_IDS = 4096, 1 << 22
_ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


@dataclass
class EliasFano:
    """A sequence of ascending whole numbers from 0."""

    n: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    samples: np.ndarray

    @staticmethod
    def of(values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        bits = ((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros((int(at[-1]) // 64 + 1) * 64 if n else 0, np.uint8)
        unary[at] = 1
        high = np.packbits(unary, bitorder="little").view("<u8")
        return EliasFano(n, low_bits, np.packbits(bits.reshape(-1), bitorder="little"), high, at[::SAMPLE].astype("<u4" if len(unary) < 1 << 32 else "<u8"))

    def select(self, i: int) -> int:
        """The place of set bit i of the high bits: from its sample on, word by word."""
        at = int(self.samples[i // SAMPLE])
        need, word = i % SAMPLE, at >> 6
        bits = int(self.high[word]) >> (at & 63) << (at & 63)
        while need >= (ones := bits.bit_count()):
            need, word = need - ones, word + 1
            bits = int(self.high[word])
        for _ in range(need):
            bits &= bits - 1
        return (word << 6) + (bits & -bits).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        first = i * self.low_bits
        last = first + self.low_bits
        low = int.from_bytes(self.low[first >> 3 : -(-last >> 3)].tobytes(), "little") >> (first & 7) & ((1 << self.low_bits) - 1)
        return (self.select(i) - i) << self.low_bits | low

    def some(self, a: int, b: int) -> np.ndarray:
        """Values a to b - 1, of the words between two selects."""
        if b <= a:
            return np.zeros(0, np.uint64)
        first, last = self.select(a), self.select(b - 1)
        words = self.high[first >> 6 : (last >> 6) + 1]
        at = np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")) + (first >> 6 << 6)
        at = at[(at >= first) & (at <= last)]
        low_a, low_b = a * self.low_bits, b * self.low_bits
        bits = np.unpackbits(self.low[low_a >> 3 : -(-low_b >> 3)], bitorder="little")[low_a & 7 :][: low_b - low_a].reshape(b - a, self.low_bits)
        low = (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return ((at - np.arange(a, b)).astype(np.uint64) << np.uint64(self.low_bits)) | low

    def all(self) -> np.ndarray:
        return self.some(0, self.n)

    def parts(self) -> list[bytes]:
        return [self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()]


class Shard:
    """One shard, of a file that can be read at any place, or of the bytes of one. Its ids stay in the file."""

    def __init__(self, data: bytes | memoryview | pa.NativeFile) -> None:
        self.file = data if isinstance(data, pa.NativeFile) else pa.BufferReader(data)
        size = self.file.size()
        tail = self.file.read_at(12, size - 12) if size >= 12 else b""
        if tail[-8:] != MAGIC:
            raise ValueError("not a shard of token ids")
        length = int.from_bytes(tail[:4], "little")
        self.footer = json.loads(self.file.read_at(length, size - 12 - length))
        self.ids_type = np.dtype(f"<u{self.footer['width']}")
        at = self.footer["n_ids"] * self.ids_type.itemsize
        self.bounds, at = self._sequence(at, self.footer["bounds"])
        self.keys, _ = self._sequence(at, self.footer["keys"])

    def _sequence(self, at: int, about: dict) -> tuple[EliasFano, int]:
        out = []
        for size, kind in zip(about["bytes"], ("u1", "<u8", about["samples"])):
            out.append(np.frombuffer(self.file.read_at(size, at) if size else b"", kind))
            at += size
        return EliasFano(about["n"], about["low_bits"], *out), at

    def __len__(self) -> int:
        return self.bounds.n - 1

    def ids(self, first: int, end: int) -> np.ndarray:
        """Ids number first to end - 1 of the shard."""
        size = self.ids_type.itemsize
        return np.frombuffer(self.file.read_at((end - first) * size, first * size), self.ids_type) if end > first else np.zeros(0, self.ids_type)

    def doc_id(self, i: int) -> int | None:
        k = i - self.footer["n_null"]
        return None if k < 0 else self.keys[k] + self.footer["least"]

    def document(self, i: int) -> np.ndarray:
        return self.ids(self.bounds[i], self.bounds[i + 1])

    def doc_ids(self, a: int, b: int) -> list[int | None]:
        """Of documents a to b - 1."""
        n = self.footer["n_null"]
        known = self.keys.some(max(0, a - n), max(0, b - n))
        return [None] * max(0, min(b, n) - a) + [int(x) + self.footer["least"] for x in known]

    def blocks(self) -> Iterator[tuple[int, np.ndarray]]:
        """Runs of documents, of about BLOCK_IDS ids or BLOCK_DOCS documents: the first and the boundaries."""
        first = 0
        while first < len(self):
            ends = self.bounds.some(first, min(len(self), first + BLOCK_DOCS) + 1).astype(np.int64)
            n = max(1, int(np.searchsorted(ends, ends[0] + BLOCK_IDS, "right")) - 1)
            yield first, ends[: n + 1]
            first += min(n, len(ends) - 1)


class _Writer:
    def __init__(self, where: fs.FileSystem, path: str, width: int) -> None:
        self.where, self.path, self.width = where, path, width
        self.out = where.open_output_stream(path)
        self.ends, self.keys, self.n_null = [0], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if doc_id is None:
            self.n_null += 1
        else:
            self.keys.append(doc_id)
        values = np.frombuffer(ids, "<u4")
        if self.width < 4 and len(values) and int(values.max()) >= 1 << 8 * self.width:
            raise OverflowError(f"id {int(values.max())} does not fit {self.width} bytes")
        self.out.write(values.astype(f"<u{self.width}").tobytes())
        self.ends.append(self.ends[-1] + len(ids) // 4)

    def full(self, n: int) -> bool:
        """Whether a document of n ids is to begin a new shard."""
        return len(self.ends) > SHARD_DOCS or len(self.ends) > 1 and self.ends[-1] + n > SHARD_IDS

    def close(self) -> dict:
        least = self.keys[0] if self.keys else 0
        shifted = [k - least for k in self.keys]
        footer = {"n_ids": self.ends[-1], "n_docs": len(self.ends) - 1, "width": self.width, "n_null": self.n_null, "least": least}
        for name, values in (("bounds", self.ends), ("keys", shifted)):
            ef = EliasFano.of(np.array(values, np.uint64))
            parts = ef.parts()
            footer[name] = {"n": ef.n, "low_bits": ef.low_bits, "bytes": [len(p) for p in parts], "samples": ef.samples.dtype.str}
            for part in parts:
                self.out.write(part)
        text = json.dumps(footer).encode()
        self.out.write(text + len(text).to_bytes(4, "little") + MAGIC)
        self.out.close()
        return footer


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def write(docs: DataFrame, uri: str, vocabulary: str, *, end_id: int = 0, width: int | None = None, n_shards: int | None = None, special_as_text: bool = True, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Writes the shards and their manifest; returns the manifest's rows. width: bytes of an id (None: as the vocabulary needs); n_shards: ranges of documents, a shard each at least."""
    width = width or (2 if max(tokens.top_id(vocabulary), end_id) < 1 << 16 else 4)
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = rows.repartitionByRange(n_shards or scratch.partitions(spark), F.col("doc_id").asc_nulls_first())
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    where, folder = _open(uri)
    where.create_dir(folder, recursive=True)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encode, end = TaskContext.get(), tokens.encoder(vocabulary, special_as_text), np.array([end_id], "<u4").tobytes()
        here, at = _open(uri)
        writer, done = None, []

        def finished() -> None:
            footer, name = writer.close(), f"shard-{task.partitionId():05d}-{len(done):05d}.tok"
            if here.get_file_info(f"{at}/{name}").type == fs.FileType.NotFound:
                here.move(writer.path, f"{at}/{name}")
            else:  # an earlier attempt wrote the same
                here.delete_file(writer.path)
            done.append((name, footer["n_docs"], footer["n_ids"]))

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), tokens.each(batch.column(1))):
                ids = encode(text) + end
                if writer is not None and writer.full(len(ids) // 4):
                    finished()
                    writer = None
                if writer is None:
                    writer = _Writer(here, f"{at}/.part-{task.partitionId():05d}-{len(done):05d}.{task.taskAttemptId()}", width)
                writer.add(key, ids)
        if writer is not None:
            finished()
            names, n_docs, n_ids = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(n_docs, pa.int64()), pa.array(n_ids, pa.int64())], names=["name", "n_docs", "n_ids"])

    made = sorted(rows.mapInArrow(save, "name string, n_docs long, n_ids long").collect())  # a row a shard
    manifest, start = [], 0
    for r in made:
        manifest.append({"name": r["name"], "n_docs": r["n_docs"], "n_ids": r["n_ids"], "start": start})
        start += r["n_ids"]
    with where.open_output_stream(f"{folder}/manifest.json") as out:
        out.write(json.dumps({"shards": manifest, "n_ids": start}).encode())
    return manifest


def read(spark: SparkSession, uri: str, *, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if wished, ids (array<int>) of each document in the shards."""
    where, folder = _open(uri)
    with where.open_input_stream(f"{folder}/manifest.json") as source:
        shards = json.loads(source.read())["shards"]
    schema = _ROWS + ", ids array<int>" * with_ids

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, at = _open(uri)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with here.open_input_file(f"{at}/{name}") as source:
                    shard = Shard(source)
                    for first, ends in shard.blocks():
                        ids, ends = shard.ids(int(ends[0]), int(ends[-1])), ends - ends[0]
                        begins = start + int(shard.bounds[first])
                        crc = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
                        keys = pa.array(shard.doc_ids(first, first + len(crc)), pa.int64())
                        out = [keys, pa.array(begins + ends[:-1]), pa.array(np.diff(ends)), pa.array(crc, pa.int64())]
                        if with_ids:
                            out.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32))))
                        yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    rows = [(s["name"], s["start"]) for s in shards]
    listed = spark.createDataFrame(rows, "name string, start long")
    return listed.repartition(max(1, len(rows)), "name").mapInArrow(load, schema)
