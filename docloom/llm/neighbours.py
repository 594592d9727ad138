"""Nearest neighbours through few stable projections and a kd-tree (after SRS; Sun and others, 2014).

Vectors are projected to DIMENSIONS by one Gaussian matrix. For a vector at distance r of
the query the squared projected distance divided by r * r has a chi-square distribution
with DIMENSIONS degrees of freedom. One kd-tree, whose planes are medians of a sample of
SAMPLE projections, routes all vectors to its leaves, and each leaf keeps the box of all its
projections. A query visits the leaves in the order of their least projected distance, in
rounds of 1, 4, 16 and so on; in a leaf, vectors are taken in the order of projected distance,
in growing steps, and verified by the exact distance, until the test holds: had a vector
nearer than the k-th best so far been missed, its projected distance would now be exceeded
with probability SURE. A query whose next leaf passes the test is done. The
expected recall is SURE at least.

All vectors are in the leaves; the sample only places the planes. A leaf of more than
block_rows vectors, as of many copies, is in parts, and one that many queries visit meets
them in blocks of block_queries.

Defined results: vectors that are null, of zero length, or hold a null, NaN or infinite
component take no part, as query or candidate, as do those of another dimension than
most; a row with a null id takes no part; a query is not its own candidate (rows that
repeat its id are neither); equal distances are in order of id; a row that is there twice
counts once; with fewer candidates than k all are returned; an empty table gives no rows.
Other columns are ignored.

Data sizes: a round moves the vectors of visited leaves once, and each query once for each
leaf that it visits; how many these are is the data's nature, from a few leaves in clusters
to half of all in noise. All groups have bounded sizes, and k rows a query and part are
merged. The driver holds the sample's projections and a box a leaf, of 2048 leaves at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import scratch

DIMENSIONS = 16
SURE = 0.97
#: Projected neighbours that are taken first, and queries that are compared with a part at once.
FIRST, QUERIES = 128, 256
#: Vectors in a part of a leaf, and queries that meet it at once.
BLOCK_ROWS, BLOCK_QUERIES = 4_096, 4_096
#: Projections that the planes of the routing tree are fitted on; a leaf has LEAST_SAMPLE of them at least.
SAMPLE, LEAST_SAMPLE = 32_768, 16
SEED = 11
#: Of squared lengths, what rounding may add to a squared distance.
SLACK = 1e-12


def chi_square_quantile(p: float, m: int) -> float:
    """The p-quantile of the chi-square distribution with an even number m of degrees of freedom."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        term, total = 1.0, 1.0
        for i in range(1, m // 2):
            term *= mid / 2 / i
            total += term
        if 1 - np.exp(-mid / 2) * total < p:
            low = mid
        else:
            high = mid
    return high


class Router:
    """The planes of a kd-tree of 2**depth leaves: medians of the sample along the axis of its widest spread."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        self.depth = depth
        self.axis, self.cut = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
        own = {0: sample}
        for node in range((1 << depth) - 1):
            points = own.pop(node)
            if len(points):
                self.axis[node] = int(np.argmax(points.max(0) - points.min(0)))
                self.cut[node] = np.median(points[:, self.axis[node]])
            right = points[:, self.axis[node]] >= self.cut[node]
            own[2 * node + 1], own[2 * node + 2] = points[~right], points[right]

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] >= self.cut[node])
        return node - ((1 << self.depth) - 1)


def search(vectors: np.ndarray, points: np.ndarray, ids: np.ndarray, queries: np.ndarray, projected: np.ndarray, own: np.ndarray, k: int, bound: float, limits: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its place, and the ids and squared distances of the k nearest found, ties to the smaller id.

    points and projected are the projections of vectors and queries; own is each query's id; a limit is a squared
    distance that k others keep already. Projected neighbours are taken nearest first, FIRST and then twice as many
    each time, until the test holds. Products of matrices tell which of them may be near enough; their
    distances are then those of the differences.
    """
    size, low = (vectors * vectors).sum(1), (points * points).sum(1)
    for a in range(0, len(queries), QUERIES):
        q, p = queries[a : a + QUERIES], projected[a : a + QUERIES]
        q_size, p_size = (q * q).sum(1), (p * p).sum(1)
        near = np.maximum(0, low + p_size[:, None] - 2 * (p @ points.T))
        far = size + q_size[:, None] - 2 * (q @ vectors.T)
        for r in range(len(q)):
            kept, slack = float(limits[a + r]), SLACK * (p_size[r] + low)
            left = np.flatnonzero((near[r] <= bound * kept + slack) & (ids != own[a + r]))
            best_d, best_i, batch = np.zeros(0), np.zeros(0, np.int64), max(FIRST, 2 * k)
            while len(left):
                if len(left) > batch:
                    order = np.argpartition(near[r][left], batch)
                    rows, left = left[order[:batch]], left[order[batch:]]
                else:
                    rows, left = left, left[:0]
                batch *= 2
                rows = rows[far[r][rows] <= kept + SLACK * (q_size[r] + size[rows])]
                gap = vectors[rows] - q[r]
                d = (gap * gap).sum(1)
                d, i = np.concatenate([best_d, d[d <= kept]]), np.concatenate([best_i, ids[rows][d <= kept]])
                top = np.lexsort((i, d))
                d, i = d[top], i[top]
                new = np.ones(len(d), bool)  # a row that is there twice counts once
                new[1:] = (d[1:] != d[:-1]) | (i[1:] != i[:-1])
                best_d, best_i = d[new][:k], i[new][:k]
                if len(best_d) == k:
                    kept = min(kept, float(best_d[-1]))
                    left = left[near[r][left] <= bound * kept + slack[left]]
            yield a + r, best_i, best_d


def usable(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", sure: float = SURE, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is_query is true of (an expression over id_col)."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias(id_col), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    rows = rows.withColumn("q", F.coalesce(is_query, F.lit(False))).withColumnRenamed(id_col, "id")
    rows = scratch.written(rows.where(F.col("id").isNotNull() & usable(F.col("v"))), "nn-vectors")
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.count_if("q").alias("q")).orderBy(F.desc("n"), "dim").first()
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None or not sizes["q"]:
        return spark.createDataFrame([], schema)
    dim, n, n_q = sizes["dim"], sizes["n"], sizes["q"]
    rows = rows.where(F.size("v") == dim)
    matrix = np.random.default_rng(SEED).normal(size=(dim, DIMENSIONS))
    bound = chi_square_quantile(sure, DIMENSIONS)
    share = min(1.0, SAMPLE / n)
    some = rows.select("v") if share == 1 else rows.select("v").sample(share, SEED)
    sample = some.mapInArrow(lambda x: _projected(x, matrix), "p array<double>").toArrow().column("p")  # about SAMPLE rows
    points = np.array(sample.to_pylist(), np.float64).reshape(-1, DIMENSIONS)
    most = max(1, min(-(-n // block_rows), len(points) // LEAST_SAMPLE))
    router = Router(points, most.bit_length() - 1 if most & (most - 1) == 0 else most.bit_length())
    rows = scratch.written(rows.mapInArrow(lambda x: _routed(x, matrix, router), "id long, v array<double>, q boolean, leaf int"), "nn-leaves")
    boxes = rows.mapInArrow(lambda x: _boxes(x, matrix), "leaf int, n long, low array<double>, high array<double>")
    ends = [f(F.col(c)[j]).alias(f"{c}{j}") for c, f in (("low", F.min), ("high", F.max)) for j in range(DIMENSIONS)]
    held = boxes.groupBy("leaf").agg(F.sum("n").alias("n"), *ends).orderBy("leaf").toPandas()  # a row a leaf
    leaf = held["leaf"].to_numpy(np.int32)
    low, high = (held[[f"{c}{j}" for j in range(DIMENSIONS)]].to_numpy() for c in ("low", "high"))
    n_parts = F.broadcast(spark.createDataFrame(list(zip(leaf.tolist(), (-(-held["n"] // block_rows)).astype(int).tolist())), "leaf int, parts int"))  # a row a leaf
    rows = rows.join(n_parts, "leaf")
    data = rows.withColumn("part", F.pmod(F.xxhash64("id", "v"), F.col("parts")).cast("int")).select("leaf", "part", "id", "v")
    asked = scratch.written(rows.where("q").select("id", "v").distinct(), "nn-queries")

    def find(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(own) and len(asked):
            v, ids = np.stack(own["v"].to_numpy()).astype(np.float64), own["id"].to_numpy(np.int64)
            q = np.stack(asked["v"].to_numpy()).astype(np.float64)
            key = asked["id"].to_numpy(np.int64)
            for r, i, d in search(v, v @ matrix, ids, q, q @ matrix, key, k, bound, asked["limit"].to_numpy()):
                out.append(pd.DataFrame({"query_id": key[r], "vec_id": i, "score": np.sqrt(d)}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})

    best, first, batch = None, 0, 1
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")  # k rows a part visited in the round
    while first < len(leaf):
        state = asked.withColumn("kept", F.lit(float("inf")))
        if best is not None:
            worst = best.where(F.col("rank") == k).select(F.col("query_id").alias("id"), "score")
            state = asked.join(worst, "id", "left").select("id", "v", F.coalesce(F.col("score"), F.lit(float("inf"))).alias("kept"))
        step = slice(first, first + batch)
        visits = state.mapInArrow(lambda x, step=step: _visits(x, matrix, leaf, low, high, bound, step), "leaf int, id long, v array<double>, limit double")
        visits = scratch.written(visits, "nn-visits")
        met = visits.groupBy("leaf").agg(F.ceil(F.count("*") / block_queries).cast("int").alias("groups"))
        met = scratch.written(met, "nn-groups")  # a row a leaf
        if not met.take(1):
            break
        met = F.broadcast(met)
        group = F.pmod(F.xxhash64("id", F.lit(1)), F.col("groups")).cast("int")
        spread = F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group")
        left = data.join(met, "leaf").select("leaf", "part", spread, "id", "v")
        right = visits.join(met, "leaf").join(n_parts, "leaf").withColumn("group", group)
        right = right.select("leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "group", "id", "v", "limit")
        keys = ["leaf", "part", "group"]
        new = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(find, "query_id long, vec_id long, score double")
        found = new if best is None else new.unionByName(best.drop("rank"))
        found = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best = scratch.written(found.select("query_id", "rank", "vec_id", "score"), "nn-best")
        first, batch = first + batch, 4 * batch
    return best


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _projected(batches: Iterator[pa.RecordBatch], matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        p = _vectors(batch.column(0)) @ matrix
        yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(p.reshape(-1)), DIMENSIONS).cast(pa.list_(pa.float64()))], names=["p"])


def _routed(batches: Iterator[pa.RecordBatch], matrix: np.ndarray, router: Router) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        leaf = router.leaf(_vectors(batch.column("v")) @ matrix).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), batch.column("q"), pa.array(leaf)], names=["id", "v", "q", "leaf"])


def _boxes(batches: Iterator[pa.RecordBatch], matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The corners of a task's projections in each leaf."""
    for batch in batches:
        p, leaf = _vectors(batch.column("v")) @ matrix, batch.column("leaf").to_numpy()
        if not len(leaf):
            continue
        order = np.argsort(leaf, kind="stable")
        first = np.flatnonzero(np.diff(leaf[order], prepend=-1))
        corners = [pa.array(list(f.reduceat(p[order], first, 0)), pa.list_(pa.float64())) for f in (np.minimum, np.maximum)]
        n = np.diff(np.append(first, len(leaf)))
        yield pa.RecordBatch.from_arrays([pa.array(leaf[order][first]), pa.array(n, pa.int64()), *corners], names=["leaf", "n", "low", "high"])


def _visits(batches: Iterator[pa.RecordBatch], matrix: np.ndarray, leaf: np.ndarray, low: np.ndarray, high: np.ndarray, bound: float, step: slice) -> Iterator[pa.RecordBatch]:
    """The leaves of a step of each query's order that the test does not rule out, and the squared distance to beat. id, v, kept: the distance of the k-th best."""
    for batch in batches:
        limit = batch.column("kept").to_numpy() ** 2
        rows, leaves = [], []
        for r, p in enumerate(_vectors(batch.column("v")) @ matrix if batch.num_rows else ()):
            gap = np.maximum(0, np.maximum(low - p, p - high))
            least = (gap * gap).sum(1)
            order = np.argsort(least, kind="stable")[step]
            order = order[least[order] <= bound * limit[r] * (1 + 1e-9) + SLACK * (p @ p)]
            rows.append(np.full(len(order), r))
            leaves.append(leaf[order])
        at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        own = [pa.array(np.concatenate(leaves) if leaves else np.zeros(0, np.int32), pa.int32()), *(batch.column(c).take(pa.array(at)) for c in ("id", "v")), pa.array(limit[at] * (1 + 1e-9))]
        yield pa.RecordBatch.from_arrays(own, names=["leaf", "id", "v", "limit"])
