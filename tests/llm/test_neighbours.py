import numpy as np
from pyspark.sql import functions as F

from docloom.llm import neighbours
from docloom.llm.queries import op7_nearest

SCHEMA = "vec_id long, embedding array<float>, label int, q string, id string"
SMALL = "/root/testdata/sf0.01"


def plain(rows, queries, k=10):
    """Exact, over rows that take part: {query: [(vec_id, distance)]}."""
    use = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, m = np.array([i for i, _ in use]), np.array([v for _, v in use])
    out = {}
    for i, v in use:
        if queries(i):
            d = np.sqrt(((m - v) ** 2).sum(1))
            order = [x for x in np.lexsort((ids, d)) if ids[x] != i][:k]
            out[i] = [(int(ids[x]), float(d[x])) for x in order]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], SCHEMA)


def recall(got, want):
    return sum(len({v for v, _ in got.get(q, [])} & {v for v, _ in w}) for q, w in want.items()) / max(1, sum(map(len, want.values())))


def as_lists(out):
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q, own in got.items():
        assert own == sorted(own, key=lambda x: (x[1], x[0]))
    return got


def clustered(n, dim=24, seed=1):
    g = np.random.default_rng(seed)
    centres = g.normal(size=(8, dim))
    return [(i, (centres[i % 8] + 0.4 * g.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]


def test_recall_and_distances(spark):
    rows = clustered(3000)
    out = neighbours.nearest(table(spark, rows), F.col("vec_id") % 50 == 0).collect()
    got, want = as_lists(out), plain(rows, lambda i: i % 50 == 0)
    assert recall(got, want) >= 0.95 and len(out) == 600
    v = dict(rows)
    for r in out[:100]:
        gap = np.array(v[r.query_id], np.float64) - np.array(v[r.vec_id], np.float64)
        assert r.score == np.sqrt((gap * gap).sum()) and r.vec_id != r.query_id


def test_blocks_of_rows_and_queries_change_nothing_but_recall(spark):
    rows = clustered(900)
    out = neighbours.nearest(table(spark, rows), F.col("vec_id") % 9 == 0, block_rows=200, block_queries=30).collect()
    assert recall(as_lists(out), plain(rows, lambda i: i % 9 == 0)) >= 0.95 and len(out) == 1000


def test_ties_copies_and_rows_that_take_no_part(spark):
    one = [1.0, 2.0, 3.0, 4.0]
    rows = [(k, one) for k in range(30)] + [(100, None), (101, []), (102, [0.0] * 4), (103, [1.0, None, 0.0, 0.0]), (104, [float("nan")] * 4), (105, [float("inf"), 0.0, 0.0, 0.0]), (None, one), (106, [1.0]), (3, one)]
    out = as_lists(neighbours.nearest(table(spark, rows), F.col("vec_id") % 10 == 0).collect())
    assert set(out) == {0, 10, 20}
    assert out[0] == [(i, 0.0) for i in range(1, 11)] and out[10] == [(i, 0.0) for i in range(10)]


def test_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])]
    assert as_lists(neighbours.nearest(table(spark, rows), F.col("vec_id") == 0).collect()) == {0: [(2, 1.0), (1, np.sqrt(2.0))]}
    assert neighbours.nearest(table(spark, rows[:1]), F.col("vec_id") == 0).count() == 0
    assert neighbours.nearest(table(spark, []), F.col("vec_id") == 0).count() == 0
    assert neighbours.nearest(table(spark, rows), F.col("vec_id") == 9).count() == 0


def test_chi_square():
    assert abs(neighbours.chi_square_quantile(0.95, 8) - 15.507) < 0.001 and abs(neighbours.chi_square_quantile(0.5, 2) - 1.386) < 0.001


def test_the_query_on_the_given_table(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert recall(as_lists(op7_nearest(spark, SMALL).collect()), plain(rows, lambda i: i % 100 == 0)) >= 0.95
