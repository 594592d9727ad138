import json
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docloom.llm import binary, tokens
from tests.llm.helpers import documents, texts

VOCABULARY = tokens.path("byte_bpe_50k.json")


@given(st.lists(st.integers(0, 5000), max_size=700))
@settings(max_examples=80, deadline=None)
def test_elias_fano(gaps):
    values = np.cumsum([0] + gaps)
    ef = binary.EliasFano.of(values)
    assert ef.all().tolist() == values.tolist()
    assert [ef[i] for i in range(len(values))] == values.tolist()
    for a, b in [(0, 1), (len(values) // 3, len(values) // 2), (len(values) - 1, len(values)), (5, 5)]:
        assert ef.some(a, b).tolist() == values[a:b].tolist()
    top = max(1, int(values[-1]))
    assert 8 * (len(ef.low) + ef.high.nbytes) <= len(values) * (3 + max(0, np.log2(top / len(values)))) + 160


def test_elias_fano_of_nothing_and_out_of_range():
    ef = binary.EliasFano.of(np.zeros(0, np.uint64))
    assert ef.all().tolist() == []
    with pytest.raises(IndexError):
        ef[0]


@pytest.mark.parametrize("n_shards", [1, 3])
def test_round_trip(spark, tmp_path, n_shards):
    uri = f"file://{tmp_path}/tokens"
    manifest = binary.write(documents(spark), uri, VOCABULARY, n_shards=n_shards)
    out = binary.read(spark, uri, with_ids=True).collect()
    rows = sorted(texts(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    out.sort(key=lambda r: r.start)
    library = Tokenizer.from_file(VOCABULARY)
    start = 0
    assert len(out) == len(rows) and sum(m["n_docs"] for m in manifest) == len(rows)
    for r, (i, t) in zip(out, rows):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) and r.ids == ids
        start += len(ids)
    names = sorted(p.name for p in (tmp_path / "tokens").iterdir() if not p.name.startswith("."))
    assert names == sorted(["manifest.json", *(m["name"] for m in manifest)])
    shard = binary.Shard((tmp_path / "tokens" / manifest[0]["name"]).read_bytes())
    assert len(shard) == manifest[0]["n_docs"] and shard.doc_id(0) == rows[0][0]
    assert shard.document(1).tolist() == out[1].ids
    assert json.loads((tmp_path / "tokens" / "manifest.json").read_text())["n_ids"] == start


def test_wide_ids_and_bad_files(spark, tmp_path):
    uri = f"file://{tmp_path}/wide"
    binary.write(documents(spark, [(5, "a b"), (7, None)]), uri, VOCABULARY, width=4, n_shards=1)
    assert [(r.doc_id, r.start, r.n_tokens) for r in sorted(binary.read(spark, uri).collect())] == [(5, 0, 3), (7, 3, 1)]
    with pytest.raises(ValueError):
        binary.Shard(b"x" * 40)


def test_width_of_the_vocabulary_and_ids_that_do_not_fit(spark, tmp_path):
    top = max(Tokenizer.from_file(VOCABULARY).get_vocab(with_added_tokens=True).values())
    assert tokens.top_id(VOCABULARY) == top < 1 << 16
    uri = f"file://{tmp_path}/end"
    binary.write(documents(spark, [(5, "a b")]), uri, VOCABULARY, end_id=70_000, n_shards=1)
    assert binary.read(spark, uri, with_ids=True).first().ids[-1] == 70_000
    with pytest.raises(Exception, match="does not fit"):
        binary.write(documents(spark, [(5, "a b")]), f"file://{tmp_path}/low", VOCABULARY, end_id=70_000, width=2, n_shards=1)


def test_ranges_are_cut_into_shards_and_blocks(spark, tmp_path, monkeypatch):
    for name, value in (("SHARD_IDS", 60), ("SHARD_DOCS", 7), ("BLOCK_DOCS", 3), ("BLOCK_IDS", 25)):
        monkeypatch.setattr(binary, name, value)
    where, folder = binary._open(f"file://{tmp_path}")
    g = np.random.default_rng(1)
    docs = [(None if k < 9 else k - 9, g.integers(0, 50_000, g.choice([1, 4, 9, 80]))) for k in range(40)]
    made, writer = [], None
    for key, ids in docs:
        if writer is not None and writer.full(len(ids)):
            made.append((writer.path, writer.close()))
            writer = None
        writer = writer or binary._Writer(where, f"{folder}/s{len(made)}", 2)
        writer.add(key, ids.astype("<u4").tobytes())
    made.append((writer.path, writer.close()))
    assert len(made) > 6 and sum(f["n_docs"] for _, f in made) == 40
    assert all(f["n_docs"] <= 7 and (f["n_ids"] <= 60 or f["n_docs"] == 1) for _, f in made)
    back = []
    for path, _ in made:
        shard = binary.Shard(open(path, "rb").read())
        seen = 0
        for first, ends in shard.blocks():
            assert first == seen and len(ends) <= 4 and (len(ends) == 2 or ends[-1] - ends[0] <= 25)
            seen += len(ends) - 1
            back += [(key, shard.document(first + k).tolist()) for k, key in enumerate(shard.doc_ids(first, seen))]
        assert seen == len(shard)
    assert back == [(key, ids.tolist()) for key, ids in docs]


def test_empty_table(spark, tmp_path):
    uri = f"file://{tmp_path}/none"
    assert binary.write(documents(spark, []), uri, VOCABULARY) == [] and binary.read(spark, uri).count() == 0
