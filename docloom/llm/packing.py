"""Packing token pieces into sequences of a fixed length by bounded-space online best-fit.

Each task keeps a fixed number of open sequences. The set of their free spaces is one
big integer, a bit for each size of space, so that the tightest sequence with room for a
piece is the lowest set bit at or above the piece's length. If none has room and all
places are taken, the fullest sequence closes. Nothing is shuffled: pieces are packed by
the task that tokenized them, and a sequence's number is the task's number and a count.

Defined results: a null or empty text is the end id alone; texts without a doc_id are
packed like others; equal rows give equal pieces; a very long text is cut into as many
pieces as it needs, and only documents longer than a sequence are cut; an empty table gives
no rows; other columns of the input are ignored. Strings of special tokens in a text are
ordinary text, as the files' own README has it, unless special_as_text is false.

Data sizes: a task holds its open sequences' numbers and free spaces, and a bounded memory
of the tokenizer; nothing grows with the data. At most the open sequences of each task stay
partly empty, so tasks should be large: input partitions set their number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import tokens

SEQUENCE = 2048
OPEN = 256
#: Pieces of texts that a worker remembers.
REMEMBERED = 800_000


class BestFit:
    """Places pieces one by one; each place is (sequence, offset)."""

    def __init__(self, size: int = SEQUENCE, most_open: int = OPEN, first: int = 0) -> None:
        self.size, self.most_open, self.next = size, most_open, first
        self.bits, self.n_open = 0, 0
        self.at: dict[int, list[int]] = {}

    def place(self, length: int) -> tuple[int, int]:
        if not 0 < length <= self.size:
            raise ValueError(f"a piece has 1 to {self.size} ids, not {length}")
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            sequence = self._take(free)
        else:
            if self.n_open == self.most_open:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, sequence = self.size, self.next
            self.next += 1
        if left := free - length:
            self.at.setdefault(left, []).append(sequence)
            self.bits |= 1 << left
            self.n_open += 1
        return sequence, self.size - free

    def _take(self, free: int) -> int:
        stack = self.at[free]
        sequence = stack.pop()
        self.n_open -= 1
        if not stack:
            self.bits &= ~(1 << free)
        return sequence


def _cutter(vocabulary: str, end_id: int, size: int, with_ids: bool, remembered: int = REMEMBERED, special_as_text: bool = True):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.trim()
        encode = tokens.encoder(vocabulary, special_as_text, remembered)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            keys, rows = batch.column(0), ([], [], [], [], [], [])
            for at, text in enumerate(tokens.each(batch.column(1))):
                ids = encode(text) + end
                for k, first in enumerate(range(0, len(ids), 4 * size)):
                    part = ids if len(ids) <= 4 * size else ids[first : first + 4 * size]
                    values = (at, k, first // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None)
                    for column, value in zip(rows, values):
                        column.append(value)
            out = [keys.take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:5])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out.append(pa.array(rows[5], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return cut


def _placer(size: int, most_open: int):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = BestFit(size, most_open, TaskContext.get().partitionId() << 33)
        for batch in batches:
            places = [fit.place(n) for n in batch.column("length").to_pylist()]
            out = dict(zip(batch.schema.names, batch.columns))
            out["sequence_id"] = pa.array([s for s, _ in places], pa.int64())
            out["offset"] = pa.array([o for _, o in places], pa.int64())
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return place


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def _schema(docs: DataFrame, id_col: str, with_ids: bool) -> str:
    return f"doc_id {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids


def pieces(docs: DataFrame, vocabulary: str, *, end_id: int = 0, size: int = SEQUENCE, with_ids: bool = True, special_as_text: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if wished, ids of each document's pieces."""
    return _texts(docs, id_col, text_col).mapInArrow(_cutter(vocabulary, end_id, size, with_ids, special_as_text=special_as_text), _schema(docs, id_col, with_ids))


def packed(parts: DataFrame, *, size: int = SEQUENCE, most_open: int = OPEN) -> DataFrame:
    """parts with sequence_id and offset; the column length says how many ids a piece has."""
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema if f.name not in ("sequence_id", "offset")]
    return parts.drop("sequence_id", "offset").mapInArrow(_placer(size, most_open), ", ".join([*kept, "sequence_id long", "offset long"]))


def packed_texts(docs: DataFrame, vocabulary: str, *, end_id: int = 0, size: int = SEQUENCE, most_open: int = OPEN, with_ids: bool = True, remembered: int = REMEMBERED, special_as_text: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """pieces and packed in one step: a task's pieces are placed by the process that cuts them. remembered: pieces of texts that a worker keeps."""
    cut, place = _cutter(vocabulary, end_id, size, with_ids, remembered, special_as_text), _placer(size, most_open)
    return _texts(docs, id_col, text_col).mapInArrow(lambda batches: place(cut(batches)), _schema(docs, id_col, with_ids) + ", sequence_id long, offset long")
