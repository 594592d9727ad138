import random

from docloom.llm import mixing
from tests.llm.helpers import documents, words


def water_filled(sizes, weights, budget, limit):
    """Plain: hold what is over its limit, share the rest by weight, again."""
    held = {}
    while True:
        free = {s: w for s, w in weights.items() if s not in held}
        level = (budget - sum(held.values())) / sum(free.values()) if free else 0
        over = {s: limit * sizes[s] for s, w in free.items() if w * level > limit * sizes[s]}
        if not over:
            return held | {s: w * level for s, w in free.items()}
        held |= over


def order(source):
    return (source is None, (source or "").encode())


def test_targets_and_taken(spark):
    docs = documents(spark)
    rows = docs.select("doc_id", "text", "source").collect()
    out = mixing.taken(docs, seed=1).collect()
    assert len(out) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=order))}
    want = water_filled(sizes, weights, 1.5 * sum(sizes.values()), 2)
    got = {}
    for r in out:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.source_size == sizes[r.source] and r.taken == r.size * r.copies <= 2 * r.size
        got[r.source] = got.get(r.source, 0) + r.taken
    longest = {s: max(len(words(r.text)) for r in rows if r.source == s) for s in sizes}
    for s in sizes:
        assert abs(got[s] - want[s]) <= longest[s]
    again = mixing.taken(docs, seed=1).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))


def test_many_small_documents_meet_their_targets(spark):
    g = random.Random(4)
    rows = [(k, f"s{g.choice([0, 0, 0, 1, 2, 3])}", " ".join(["w"] * g.randint(1, 9))) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.taken(docs).groupBy("source", "target").sum("taken").collect()
    for r in out:
        assert abs(r["sum(taken)"] - r["target"]) <= 9


def test_fewer_epochs_than_wished_and_weights_that_are_missing(spark):
    docs = spark.createDataFrame([(1, "a", "x y"), (2, "b", "x"), (3, None, "x y z")], "doc_id long, source string, text string")
    weights = spark.createDataFrame([("a", 1.0), (None, 3.0)], "source string, weight double")
    out = {r.doc_id: r for r in mixing.taken(docs, weights, share=5.0, max_epochs=2.0).collect()}
    assert out[1].target == 4 and out[3].target == 6 and out[2].target == 0 and out[2].taken == 0


def test_neither_broadcasts_nor_the_number_of_bins_matter(spark, monkeypatch):
    docs = documents(spark)
    few = sorted(map(repr, mixing.taken(docs).collect()))
    monkeypatch.setattr(mixing, "BIN_ROWS", 1)
    monkeypatch.setattr(mixing, "BIN_BITS", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert few == sorted(map(repr, mixing.taken(docs).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_mixed_keeps_rows_whole(spark):
    docs = documents(spark)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    want = {}
    for r in mixing.taken(docs).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    got = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {k: n for k, n in want.items() if n}


def test_empty_table(spark):
    docs = documents(spark, [])
    assert mixing.taken(docs).count() == 0 and mixing.mixed(docs).count() == 0


def test_all_texts_empty(spark):
    docs = documents(spark, [(1, ""), (2, None)])
    assert [(r.size, r.target, r.taken) for r in mixing.taken(docs).collect()] == [(0, 0.0, 0)] * 2


def test_rank_over_many_partitions(spark):
    from pyspark.sql import functions as F

    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(5)
    out = mixing.ranked(df, F.col("v").asc())
    assert all(r.v == r["rank"] for r in out.collect())
