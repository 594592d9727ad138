"""A byte-level convolutional network in numpy that gives a text one probability.

A text's bytes are cut into overlapping chunks that cover all of it. Learned filters over
runs of bytes are applied at every second place of a chunk and max-pooled over the chunk;
the means and maxima of a text's chunks go into one logistic unit. Bytes, filters and the
unit are trained together by Adam on a bounded sample of labelled rows, and then rounded to
whole numbers of up to LEVELS a side: a score's sums are of whole numbers, exact in any
order, so that it depends on the text alone, not on the rows that are scored beside it.

Defined results: a null or empty text is one chunk of padding and gets a probability like
any other; equal texts get equal probabilities, bit for bit; a very long text is scored in
blocks of its chunks, all of them; without labelled rows the probability is the share that
is assumed (0.5); an empty table gives no rows. Other columns are ignored.

Data sizes: the sample has at most PER_LABEL rows a label, and is cut into chunks where its
rows are; the driver gets all chunks of these and fits the network on them, BLOCK at once. Each text is then scored whole, where it is; the network is about 30 kB.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import folds, tokens, wordvec

CHUNK, STEP = 256, 224
WIDTH, STRIDE, CHANNELS, FILTERS = 10, 2, 8, 64
PER_LABEL = 2500
EPOCHS, LEAST_STEPS, BATCH, RATE, DECAY = 3, 600, 12, 0.012, 1e-4
#: Chunks that are convolved at once.
BLOCK = 96
#: A byte's values and a filter's weights are rounded to whole numbers from -LEVELS to LEVELS: a filter's sum stays below 2**24, so 32-bit floats hold it exactly.
LEVELS = 127


def n_chunks(lengths: np.ndarray) -> np.ndarray:
    return np.maximum(1, -(-(lengths - (CHUNK - STEP)) // STEP))


def chunks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Chunks from the given places, ended by zeros where their text ends."""
    at = starts[:, None] + np.arange(CHUNK)
    inside = at < ends[:, None]
    return np.where(inside, data[np.minimum(at, max(0, len(data) - 1))], 0).astype(np.uint8) if len(data) else np.zeros(at.shape, np.uint8)


@dataclass
class Network:
    bytes_: np.ndarray  # 256 x CHANNELS
    filters: np.ndarray  # WIDTH * CHANNELS x FILTERS
    bias: np.ndarray
    mean: np.ndarray
    max_: np.ndarray
    offset: np.ndarray

    @staticmethod
    def new(seed: int) -> Network:
        g = np.random.default_rng(seed)
        f = np.float32
        return Network(
            g.normal(0, 0.5, (256, CHANNELS)).astype(f), g.normal(0, 1 / np.sqrt(WIDTH * CHANNELS), (WIDTH * CHANNELS, FILTERS)).astype(f),
            np.zeros(FILTERS, f), g.normal(0, 0.1, FILTERS).astype(f), g.normal(0, 0.02, FILTERS).astype(f), np.zeros(1, f),
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.bytes_, self.filters, self.bias, self.mean, self.max_, self.offset]

    def pooled(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each chunk the highest value of each filter, and where it is."""
        x = self.bytes_[block]
        seen = np.lib.stride_tricks.sliding_window_view(x.reshape(len(block), -1), WIDTH * CHANNELS, axis=1)[:, :: STRIDE * CHANNELS]
        seen = np.ascontiguousarray(seen)
        out = seen.reshape(-1, WIDTH * CHANNELS) @ self.filters
        out = out.reshape(len(block), -1, FILTERS)
        at = out.argmax(1)
        best = np.take_along_axis(out, at[:, None], 1)[:, 0] + self.bias
        return best, at

    def logits(self, chunk_features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """first: where each text's chunks begin; each has one at least."""
        mean = np.add.reduceat(chunk_features, first, 0) / np.diff(np.append(first, len(chunk_features)))[:, None]
        return mean @ self.mean + np.maximum.reduceat(chunk_features, first, 0) @ self.max_ + self.offset

    def gradients(self, block: np.ndarray, at: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the filters and the bytes, from the slopes at the places that pooling chose."""
        spots = (at * STRIDE)[:, :, None] + np.arange(WIDTH)
        which = block[np.arange(len(draw))[:, None, None], spots]
        windows = self.bytes_[which].reshape(len(draw), FILTERS, WIDTH * CHANNELS)  # chunk x filter x width
        dfilters = np.einsum("cf,cfw->wf", draw, windows, optimize=True)
        values = (draw[:, :, None] * self.filters.T[None]).reshape(-1, CHANNELS)
        flat = which.reshape(-1)
        return dfilters, np.stack([np.bincount(flat, values[:, c], 256) for c in range(CHANNELS)], 1)


@dataclass
class Rounded:
    """A network of whole numbers. A filter's value is its sum times its unit."""

    bytes_: np.ndarray  # 256 x CHANNELS
    filters: np.ndarray  # WIDTH * CHANNELS x FILTERS
    unit: np.ndarray
    bias: np.ndarray  # in units
    mean: np.ndarray  # of a filter's sum, not of its value
    max_: np.ndarray
    offset: float

    @staticmethod
    def of(net: Network) -> Rounded:
        size = np.maximum(np.abs(net.bytes_).max(0), 1e-12).astype(np.float64) / LEVELS
        wide = net.filters.astype(np.float64) * np.tile(size, WIDTH)[:, None]
        unit = np.maximum(np.abs(wide).max(0), 1e-18) / LEVELS
        return Rounded(
            np.rint(net.bytes_ / size).astype(np.float32), np.rint(wide / unit).astype(np.float32), unit, np.rint(net.bias / unit).astype(np.int64),
            net.mean * unit, net.max_ * unit, float(net.offset[0]),
        )

    def pooled(self, block: np.ndarray) -> np.ndarray:
        """Of each chunk the highest sum of each filter, 0 at least."""
        x = self.bytes_[block]
        seen = np.lib.stride_tricks.sliding_window_view(x.reshape(len(block), -1), WIDTH * CHANNELS, axis=1)[:, :: STRIDE * CHANNELS]
        out = np.ascontiguousarray(seen).reshape(-1, WIDTH * CHANNELS) @ self.filters
        return np.maximum(out.reshape(len(block), -1, FILTERS).max(1).astype(np.int64) + self.bias, 0)

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each row's whole text."""
        counts = n_chunks(np.diff(offsets))
        first = np.concatenate([[0], np.cumsum(counts)])
        total, top = np.zeros((len(counts), FILTERS), np.int64), np.zeros((len(counts), FILTERS), np.int64)
        for a in range(0, int(first[-1]), BLOCK):
            k = np.arange(a, min(a + BLOCK, int(first[-1])))
            row = np.searchsorted(first, k, "right") - 1
            own = self.pooled(chunks(data, offsets[row] + (k - first[row]) * STEP, offsets[row + 1]))
            begins = np.flatnonzero(np.diff(row, prepend=-1))
            total[row[begins]] += np.add.reduceat(own, begins, 0)
            top[row[begins]] = np.maximum(top[row[begins]], np.maximum.reduceat(own, begins, 0))
        z = np.full(len(counts), self.offset)
        for f in range(FILTERS):  # in this order for each row
            z = z + total[:, f] / counts * self.mean[f] + top[:, f] * self.max_[f]
        return 1 / (1 + np.exp(-z))


def fit(texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, *, seed: int = 7, epochs: int = EPOCHS, least_steps: int = LEAST_STEPS) -> Network:
    """texts: each one's chunks. The loss is logistic, weighted by row. Few texts are gone through more often, for at least so many steps."""
    net, g = Network.new(seed), np.random.default_rng(seed + 1)
    share = float(np.clip((labels * weights).sum() / max(weights.sum(), 1e-9), 0.01, 0.99)) if len(labels) else 0.5
    net.offset[:] = np.log(share / (1 - share))
    first_moment = [np.zeros_like(p) for p in net.parameters()]
    second_moment = [np.zeros_like(p) for p in net.parameters()]
    a_pass = max(1, -(-len(texts) // BATCH))
    epochs = max(epochs, -(-least_steps // a_pass)) if len(texts) else 0
    step, total = 0, epochs * a_pass
    for _ in range(epochs):
        order = g.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            own = order[a : a + BATCH]
            block = np.concatenate([texts[i] for i in own])
            counts = np.array([len(texts[i]) for i in own])
            first = np.concatenate([[0], np.cumsum(counts)[:-1]])
            parts = [slice(a, a + BLOCK) for a in range(0, len(block), BLOCK)]
            raw, at = (np.concatenate(x) for x in zip(*(net.pooled(block[part]) for part in parts)))
            active = np.maximum(raw, 0)
            z = net.logits(active, first)
            w = weights[own] / weights[own].mean()
            dz = ((1 / (1 + np.exp(-z)) - labels[own]) * w / len(own)).astype(np.float32)
            means = np.add.reduceat(active, first, 0) / counts[:, None]
            tops = np.maximum.reduceat(active, first, 0)
            row = np.repeat(np.arange(len(own)), counts)
            dactive = (dz / counts)[row, None] * net.mean + np.where(active == tops[row], dz[row, None] * net.max_, 0)
            draw = np.where(raw > 0, dactive, 0).astype(np.float32)
            found = [net.gradients(block[part], at[part], draw[part]) for part in parts]
            dfilters, dbytes = sum(x for x, _ in found), sum(x for _, x in found)
            gradients = [dbytes, dfilters + DECAY * net.filters, draw.sum(0), dz @ means + DECAY * net.mean, dz @ tops + DECAY * net.max_, dz.sum(keepdims=True)]
            step += 1
            rate = RATE * (0.5 + 0.5 * np.cos(np.pi * step / total)) + 1e-5
            for p, d, m, v in zip(net.parameters(), gradients, first_moment, second_moment):
                m += 0.1 * (d - m)
                v += 0.01 * (d * d - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def probabilities(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each row's whole text, by the rounded network."""
    return Rounded.of(net).probabilities(data, offsets)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All chunks of training texts."""
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            data, offsets = wordvec.buffers(batch.column(1).slice(i, 1))
            n = int(n_chunks(np.array([len(data)]))[0])
            at = np.arange(n) * STEP
            out.append(chunks(data, at, np.full(len(at), len(data))).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), batch.column(2)], names=["_id", "chunks", "label"])


def trained(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", folds_: int = 5, held_out: int = 0, per_label: int = PER_LABEL, seed: int = 7, **how: int) -> Network:
    """how: epochs and least_steps of the fit."""
    sample, weights = folds.sampled(docs, labels, label_col, folds=folds_, held_out=held_out, per_label=per_label)
    kind = sample.schema["_id"].dataType.simpleString()
    rows = sample.select("_id", "text", "label").mapInArrow(_cut, f"_id {kind}, chunks binary, label int").toPandas()  # at most 2 * per_label rows, with whole texts
    rows = rows.sort_values("_id", kind="stable")
    texts = [np.frombuffer(x, np.uint8).reshape(-1, CHUNK) for x in rows["chunks"]]
    y = rows["label"].to_numpy(np.float32)
    return fit(texts, y, np.array([weights[int(k)] for k in y], np.float32), seed=seed, **how)


def scored(docs: DataFrame, net: Network, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """row (a struct of all columns of docs), score and predicted."""
    kept = [c for c in docs.columns]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept if c != text_col]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    held = pickle.dumps(Rounded.of(net), 5)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        own = pickle.loads(held)
        for batch in batches:
            data, offsets = wordvec.buffers(batch.column(1))
            out = [own.probabilities(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in wordvec.runs(offsets, 1 << 20)]
            p = np.concatenate(out) if out else np.zeros(0)
            columns = [batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "text", "score", "predicted"])
        tokens.trim()

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(score, f"row {kind}, text string, score double, predicted int")
