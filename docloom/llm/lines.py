"""Removing lines that many documents share, by a sharded minimal perfect hash.

All distinct line hashes are counted. Those that enough documents have are split into
shards. A shard gives each of its hashes a number of its own from 0 (levels of bit arrays:
a hash that is alone at its place in a level gets its number there, the others go on to the
next) and keeps a fingerprint of 16 bits and a document count of 16 bits at that number.
All other distinct hashes then probe the arrays once; the few that have a number's
fingerprint without being its hash are kept beside the arrays, so that the compact
fingerprints answer for no line of the corpus that is not indexed. Documents probe these
arrays; no line is joined with another, and the plan is one at all sizes.

Defined results: a null or empty text is one empty line; a line whose key has fewer than
min_key code points is never dropped; each row counts as a document, also one that
repeats another's id or text; a very long text is split whole; a text of which all lines
are dropped becomes empty; a null doc_id is kept. An empty table gives no rows. Other
columns are ignored (``cleaned``: kept).

Data sizes: a task sends each distinct line hash once with its count, so a line that all
documents share is one row a task. The shards lie in the shared folder, about a megabyte
each; a worker loads those that its lines ask for and keeps at most MOST_BYTES of them. An
index above that is read anew for each batch of texts. Lines that few documents have are not
indexed: they are nearly all, and none of them can be dropped.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import scratch, tokens
from docloom.llm.wordvec import mix

SPACE = b" \t\n\x0b\x0c\r"
#: About so many hashes are in a shard.
SHARD_ROWS = 1 << 18
#: Bytes of arrays that a worker keeps.
MOST_BYTES = 64 << 20
#: Texts whose lines probe the index at once.
STEP = 512
#: Counts from here on are one.
MOST_COUNT = (1 << 16) - 1
#: Distinct hashes that a task holds before it sends them on.
HELD = 400_000


def split(text: bytes) -> list[bytes]:
    return text.split(b"\n")


def keys(lines: list[bytes]) -> list[bytes]:
    """White space of ASCII is stripped at both ends and A-Z are lower-cased."""
    return [line.strip(SPACE).lower() for line in lines]


def key_hash(key: bytes) -> int:
    return xxhash.xxh3_64_intdigest(key)


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


@dataclass
class Shard:
    """Arrays of one shard: each hash has a number from 0 to n - 1, and no two the same."""

    bits: list[np.ndarray]
    ranks: list[np.ndarray]
    rest: np.ndarray
    fingerprints: np.ndarray
    counts: np.ndarray
    others: np.ndarray  # hashes outside the shard that have the fingerprint of their number

    @staticmethod
    def of(hashes: np.ndarray, counts: np.ndarray, gamma: float = 1.7, most_levels: int = 48) -> Shard:
        left, bits, ranks, base = hashes.astype(np.uint64), [], [], 0
        while len(left) and len(bits) < most_levels:
            size = max(64, -(-int(len(left) * gamma) // 64) * 64)
            at = _place(left, len(bits), size)
            alone = np.bincount(at, minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view("<u8").astype(np.uint64)
            below = np.concatenate([[0], np.cumsum(np.bitwise_count(words))[:-1]]).astype(np.int64) + base
            bits.append(words)
            ranks.append(below)
            base += int(alone.sum())
            left = left[~alone[at]]
        shard = Shard(bits, ranks, np.sort(left), np.zeros(len(hashes), np.uint16), np.zeros(len(hashes), np.uint16), np.zeros(0, np.uint64))
        at = shard.number(hashes)
        shard.fingerprints[at] = _fingerprint(hashes)
        shard.counts[at] = np.minimum(counts, MOST_COUNT)
        return shard

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (*self.bits, *self.ranks, self.rest, self.fingerprints, self.counts, self.others))

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash that the shard holds; for others any number or -1."""
        out = np.full(len(hashes), -1, np.int64)
        open_ = np.arange(len(hashes))
        for level, (words, below) in enumerate(zip(self.bits, self.ranks)):
            at = _place(hashes[open_], level, len(words) * 64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            rank = below[at >> 6] + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[hit]] = rank[hit]
            open_ = open_[~hit]
            if not len(open_):
                return out
        if len(self.rest):
            base = len(self.fingerprints) - len(self.rest)
            at = np.minimum(np.searchsorted(self.rest, hashes[open_]), len(self.rest) - 1)
            known = self.rest[at] == hashes[open_]
            out[open_[known]] = base + at[known]
        return out

    def count(self, hashes: np.ndarray) -> np.ndarray:
        """How many documents have the line (MOST_COUNT at most), for hashes in the index; 0 for others, if those with the fingerprint of their number are known."""
        at = self.number(hashes)
        safe = np.maximum(at, 0)
        known = (at >= 0) & (self.fingerprints[safe] == _fingerprint(hashes)) if len(self.fingerprints) else np.zeros(len(at), bool)
        if len(self.others) and known.any():
            known &= ~np.isin(hashes, self.others)
        return np.where(known, self.counts[safe] if len(self.counts) else 0, 0)


def _fingerprint(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(48)).astype(np.uint16)


def _place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(hashes + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)


class Index:
    """Shards by the leading part of the hash, loaded when they are asked for; the last used are kept, up to so many bytes."""

    def __init__(self, load: Callable[[int], Shard | None], n_shards: int, most_bytes: int = MOST_BYTES) -> None:
        self.load, self.n_shards, self.most_bytes = load, n_shards, most_bytes
        self.held: OrderedDict[int, Shard | None] = OrderedDict()
        self.size = 0

    def shard(self, k: int) -> Shard | None:
        if k in self.held:
            self.held.move_to_end(k)
            return self.held[k]
        found = self.held[k] = self.load(k)
        self.size += found.nbytes() if found else 0
        while self.size > self.most_bytes and len(self.held) > 1:
            old = self.held.popitem(last=False)[1]
            self.size -= old.nbytes() if old else 0
        return found

    def count(self, hashes: np.ndarray) -> np.ndarray:
        out, own = np.zeros(len(hashes), np.int64), shard_of(hashes, self.n_shards)
        order = np.argsort(own, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
            if len(at) and (shard := self.shard(int(own[at[0]]))) is not None:
                out[at] = shard.count(hashes[at])
        return out


def shard_of(hashes: np.ndarray, n_shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n_shards) >> np.uint64(32)).astype(np.int64)


def line_counts(docs: DataFrame, *, text_col: str = "text", min_key: int = 1) -> DataFrame:
    """h, n: each distinct line hash and how many documents have the line."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        held: dict[int, int] = {}

        def out() -> pa.RecordBatch:
            h = np.fromiter(held.keys(), np.uint64, len(held)).view(np.int64)
            n = np.fromiter(held.values(), np.int64, len(held))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "n"])

        for batch in batches:
            for text in tokens.each(batch.column(0)):
                for key in set(keys(split(text))):
                    if long_enough(key, min_key):
                        h = key_hash(key)
                        held[h] = held.get(h, 0) + 1
                if len(held) >= HELD:
                    yield out()
        yield out()

    parts = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "h long, n long")
    return parts.groupBy("h").agg(F.sum("n").alias("n"))


def built(frequent: DataFrame, n_shards: int) -> DataFrame:
    """shard, arrays: one row a shard; frequent has h and n."""
    at = F.shiftright((F.shiftrightunsigned("h", 32)) * F.lit(n_shards), 32).cast("int")

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        shard = Shard.of(rows["h"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy())
        return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "arrays": [pickle.dumps(shard, 5)]})

    return frequent.select(at.alias("shard"), "h", "n").groupBy("shard").applyInPandas(build, "shard int, arrays binary")


def _saved(rows: DataFrame, label: str) -> str:
    """Where rows are written as a folder for each shard."""
    path = scratch.new_path(rows.sparkSession, label)
    rows.write.partitionBy("shard").parquet(path)
    return path


def _loader(arrays: str, others: str | None = None) -> Callable[[int], Shard | None]:
    """Reads a shard by its number; none if the folder has no such one."""

    def column(path: str, k: int, name: str) -> list:
        where, folder = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
        at = f"{folder}/shard={k}"
        if where.get_file_info(at).type == fs.FileType.NotFound:
            return []
        return pyarrow.dataset.dataset(at, filesystem=where, format="parquet").to_table(columns=[name]).column(name).to_pylist()

    def load(k: int) -> Shard | None:
        found = column(arrays, k, "arrays")
        if not found:
            return None
        shard = pickle.loads(found[0])
        if others:
            shard.others = np.sort(np.array(column(others, k, "h"), np.int64).view(np.uint64))
        return shard

    return load


def indexed(docs: DataFrame, *, text_col: str = "text", min_docs: int = 10, min_key: int = 1) -> tuple[Callable[[int], Shard | None], int]:
    """A loader of the shards of the lines that at least min_docs documents have, and their number."""
    counts = scratch.written(line_counts(docs, text_col=text_col, min_key=min_key), "lines-counts")
    frequent = counts.where(F.col("n") >= min_docs)
    n_shards = max(1, -(-frequent.count() // SHARD_ROWS))
    arrays = _saved(built(frequent, n_shards), "lines-shards")

    def unlucky(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(_loader(arrays), n_shards)
        for batch in batches:
            hashes = batch.column(0).to_numpy().view(np.uint64)
            hit = hashes[index.count(hashes) > 0]
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(hit, n_shards).astype(np.int32)), pa.array(hit.view(np.int64))], names=["shard", "h"])

    others = _saved(counts.where(F.col("n") < min_docs).select("h").mapInArrow(unlucky, "shard int, h long").repartition("shard"), "lines-others")  # one in 65,536
    return _loader(arrays, others), n_shards


def dropped_positions(index: Index, lists: list[list[bytes]], min_docs: int, min_key: int) -> list[np.ndarray]:
    """For each list of keys, which of them are to go."""
    flat = [key for own in lists for key in own]
    known: dict[bytes, int] = {}
    for key in flat:
        known.setdefault(key, len(known))
    unique = list(known)
    h = np.fromiter(map(key_hash, unique), np.uint64, len(unique))
    enough = np.fromiter((long_enough(key, min_key) for key in unique), bool, len(unique))
    gone = (index.count(h) >= min_docs) & enough
    each = gone[np.fromiter((known[key] for key in flat), np.int64, len(flat))]
    return np.split(each, np.cumsum([len(own) for own in lists])[:-1]) if lists else []


CLEANED = "text string, n_lines long, n_dropped long, kept_sha256 string"


def cleaned(docs: DataFrame, *, text_col: str = "text", min_docs: int = 10, min_key: int = 1, most_bytes: int = MOST_BYTES) -> DataFrame:
    """row (a struct of all columns of docs but the text) and the columns of CLEANED, a row for each row of docs. min_docs is MOST_COUNT at most."""
    if min_docs > MOST_COUNT:
        raise ValueError(f"counts end at {MOST_COUNT}")
    load, n_shards = indexed(docs, text_col=text_col, min_docs=min_docs, min_key=min_key)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]) if len(docs.columns) > 1 else F.struct(F.lit(1).alias("none"))
    rows = docs.select(row.alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(load, n_shards, most_bytes)
        for batch in batches:
            yield from _rewritten(batch, lambda lists: dropped_positions(index, lists, min_docs, min_key))

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(clean, f"row {kind}, {CLEANED}")


def _rewritten(batch: pa.RecordBatch, gone_of) -> Iterator[pa.RecordBatch]:
    for first in range(0, batch.num_rows, STEP):
        part = batch.slice(first, STEP)
        lists = [split(text) for text in tokens.each(part.column(1))]
        texts, dropped = [], []
        for own, gone in zip(lists, gone_of([keys(own) for own in lists])):
            n = int(gone.sum())
            texts.append(b"\n".join(own) if not n else b"\n".join([line for line, g in zip(own, gone) if not g]))
            dropped.append(n)
        columns = [part.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array([len(x) for x in lists], pa.int64()), pa.array(dropped, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "text", "n_lines", "n_dropped", "kept_sha256"])


def without_shared_lines(docs: DataFrame, *, text_col: str = "text", min_docs: int = 10, min_key: int = 1) -> DataFrame:
    """docs with the shared lines gone from the text, all other columns as they are."""
    out = cleaned(docs, text_col=text_col, min_docs=min_docs, min_key=min_key)
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
