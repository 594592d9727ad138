import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import lines
from tests.llm.helpers import documents, lower, texts


def plain(rows, min_docs=10, min_key=1):
    key = lambda line: lower(line).strip(" \t\n\x0b\x0c\r")
    split = [(i, (t or "").split("\n")) for i, t in rows]
    seen = {}
    for _, own in split:
        for k in {key(x) for x in own}:
            seen[k] = seen.get(k, 0) + 1
    out = []
    for i, own in split:
        left = [x for x in own if len(key(x)) < min_key or seen[key(x)] < min_docs]
        out.append((i, len(own), len(own) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [lines.MOST_BYTES, 1])
@pytest.mark.parametrize("shard", [1 << 18, 1])
def test_equals_brute_force(spark, most, shard, monkeypatch):
    monkeypatch.setattr(lines, "SHARD_ROWS", shard)
    rows = texts() + [(200 + k, "second shared\n" + "third   shared\n" * (k % 2)) for k in range(24)]
    out = lines.cleaned(documents(spark, rows), most_bytes=most).select("row.doc_id", "n_lines", "n_dropped", "kept_sha256")
    want = plain(rows)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == want
    assert sum(w[2] for w in want) > 40


def test_key_length_and_document_limit(spark):
    rows = [(k, "é\nab\nabc") for k in range(3)]
    out = lines.cleaned(documents(spark, rows), min_docs=3, min_key=2).select("row.doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert sorted(map(tuple, out.collect()), key=repr) == plain(rows, 3, 2)


def test_columns_stay(spark):
    docs = documents(spark)
    out = lines.without_shared_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert lines.without_shared_lines(docs.select("text")).columns == ["text"]


def test_empty_table(spark):
    assert lines.cleaned(documents(spark, [])).count() == 0


@given(st.sets(st.integers(0, 2**64 - 1), max_size=400), st.sets(st.integers(0, 2**64 - 1), max_size=50), st.floats(1.0, 3.0), st.integers(0, 6))
@settings(max_examples=80, deadline=None)
def test_minimal_perfect_hash(own, others, gamma, levels):
    h = np.array(sorted(own), np.uint64)
    shard = lines.Shard.of(h, np.arange(1, len(h) + 1), gamma, levels)
    assert sorted(shard.number(h).tolist()) == list(range(len(h)))
    assert shard.count(h).tolist() == list(range(1, len(h) + 1))
    foreign = np.array(sorted(others - own), np.uint64)
    shard.others = foreign[shard.count(foreign) > 0]
    assert shard.count(foreign).tolist() == [0] * len(foreign) and shard.count(h).tolist() == list(range(1, len(h) + 1))


def test_fingerprints_are_compact_and_answer_for_no_other_line(spark, monkeypatch):
    """With a fingerprint that is the same for all lines, those that are not indexed are told apart all the same."""
    h = np.random.default_rng(1).integers(0, 2**64, 100_000, dtype=np.uint64)
    assert lines.Shard.of(h, np.full(len(h), 70_000)).nbytes() < 5.5 * len(h)
    one = lines.Shard.of(h[:100], np.full(100, 70_000))
    assert (one.count(h[:100]) == lines.MOST_COUNT).all()
    rows = [(k, f"shared\nown line {k}\nother {k % 7}") for k in range(40)]
    loaded = lines.indexed(documents(spark, rows), min_docs=10)[0](0)
    assert len(loaded.fingerprints) == 1
    with pytest.raises(ValueError):
        lines.cleaned(documents(spark, rows), min_docs=70_000)


def test_the_index_keeps_a_bounded_part_of_itself():
    calls = []
    h = np.sort(np.random.default_rng(2).integers(0, 2**64, 4000, dtype=np.uint64))
    own = lines.shard_of(h, 8)
    made = {k: lines.Shard.of(h[own == k], np.full((own == k).sum(), 12)) for k in range(8)}
    index = lines.Index(lambda k: calls.append(k) or made[k], 8, made[0].nbytes() * 3)
    assert (index.count(h) == 12).all() and (index.count(h[::-1]) == 12).all()
    assert index.size <= made[0].nbytes() * 3 and len(calls) > 8
