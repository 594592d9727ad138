"""The registered queries on the smallest tables, against their SQL, and the pipeline against a plain version."""

import os
import zlib

import duckdb
import pytest

import corpus_pipeline
from docloom.llm import convnet, mixing, packing, scratch, tokens
from docloom.llm.queries import QUERIES
from docloom.llm.sql import SQL
from tests.llm.helpers import lower
from tests.llm.test_neardup import plain as near_plain

TINY = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "labels", "pages"):
        con.execute(f"create view {table} as select * from '{TINY}/{table}.parquet'")
    out = QUERIES[name](spark, TINY)
    columns = sorted(out.columns)
    found = con.execute(SQL[name])
    place = [[d[0] for d in found.description].index(c) for c in columns]
    want = sorted((tuple(r[k] for k in place) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r) for r in out.select(*columns).collect()), key=repr) == want and want


def test_one_query_for_each_operator():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 11)] == [1] * 10


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    columns = docs.columns
    scores = convnet.scored(docs, convnet.trained(docs, spark.read.parquet(f"{TINY}/labels.parquet")))
    good = corpus_pipeline.quality(spark, docs, TINY)
    assert good.columns == columns
    assert sorted(r.doc_id for r in good.collect()) == sorted(r[0] for r in scores.where("predicted = 1").select("row.doc_id").collect())

    key = lambda line: lower(line).strip(" \t\n\x0b\x0c\r")
    rows = [(r.doc_id, r.text) for r in good.collect()]
    seen = {}
    for _, t in rows:
        for k in {key(x) for x in t.split("\n")}:
            seen[k] = seen.get(k, 0) + 1
    kept = {i: "\n".join(x for x in t.split("\n") if not key(x) or seen[key(x)] < 10) for i, t in rows}
    lines = corpus_pipeline.line_dedup(spark, good, TINY)
    assert lines.columns == columns and {r.doc_id: r.text for r in lines.collect()} == kept
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    near = corpus_pipeline.near_dedup(spark, lines, TINY)
    assert near.columns == columns
    assert sorted(r.doc_id for r in near.collect()) == sorted(i for i, _, _, k in near_plain(list(kept.items())) if k)

    mix = corpus_pipeline.mix(spark, near, TINY)
    counts = {r["doc_id"]: r["count"] for r in mix.groupBy("doc_id").count().collect()}
    assert mix.columns == columns and counts == {r.doc_id: r.copies for r in mixing.taken(near).collect() if r.copies}

    packed = corpus_pipeline.pack(spark, mix, TINY).collect()
    pieces = packing.pieces(near, tokens.path("word_bpe_49k.json"), with_ids=False).collect()
    got, want = {}, {}
    for r in packed:
        got[(r.doc_id, r.piece, r.ids_crc32)] = got.get((r.doc_id, r.piece, r.ids_crc32), 0) + 1
    for r in pieces:
        if counts.get(r.doc_id):
            want[(r.doc_id, r.piece, r.ids_crc32)] = counts[r.doc_id]
    assert got == want


def test_the_last_stage_has_the_ids(spark):
    out = corpus_pipeline.pack(spark, spark.read.parquet(f"{TINY}/documents.parquet"), TINY).collect()
    assert out and all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in out)


def test_run_applies_all_stages(spark):
    out = corpus_pipeline.run(spark, TINY)
    assert out.count() > 50 and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "near dedup", "mix sources", "pack"] and corpus_pipeline.ORACLE_SQL is None


def test_run_leaves_its_last_table_alone(spark, monkeypatch):
    """Of what the pipeline wrote only its result stays, and the caller's setting is as it was."""
    monkeypatch.setattr(corpus_pipeline, "STAGES", [s for s in corpus_pipeline.STAGES if s[0] in ("line dedup", "mix sources", "pack")])
    folder, setting = scratch.shared_dir(spark).removeprefix("file://"), corpus_pipeline._BATCH
    before = set(os.listdir(folder))
    spark.conf.set(setting, 777)
    try:
        out = corpus_pipeline.run(spark, TINY)
        assert out.count() > 0 and spark.conf.get(setting) == "777"
    finally:
        spark.conf.unset(setting)
    assert [n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before if not n.endswith(".crc")] == ["pipeline-pack"]
