import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import packing, tokens
from tests.llm.helpers import documents, texts

VOCABULARY = tokens.path("word_bpe_49k.json")


@given(st.lists(st.integers(1, 64), max_size=200), st.integers(1, 8))
@settings(max_examples=150, deadline=None)
def test_places_equal_a_plain_best_fit(lengths, most_open):
    fit, open_, next_ = packing.BestFit(64, most_open), [], 0
    for n in lengths:
        fitting = [b for b in open_ if b[1] >= n]
        best = min((b[1] for b in fitting), default=None)
        got = fit.place(n)
        if best is None:
            if len(open_) == most_open:
                fullest = min(b[1] for b in open_)
                open_.remove(next(b for b in reversed(open_) if b[1] == fullest))
            assert got == (next_, 0)
            free = 64 - n
            if free:
                open_.append([next_, free])
            next_ += 1
        else:
            own = next(b for b in fitting if b[0] == got[0])
            assert own[1] == best and got[1] == 64 - best
            own[1] -= n
            open_ = [b for b in open_ if b is not own] + ([own] if own[1] else [])


def test_a_piece_that_cannot_fit():
    with pytest.raises(ValueError):
        packing.BestFit(8).place(9)
    with pytest.raises(ValueError):
        packing.BestFit(8).place(0)


@pytest.mark.parametrize("one_step", [True, False])
def test_pieces_and_places_give_the_ids_back(spark, one_step):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    docs = documents(spark)
    docs = docs.coalesce(1)
    out = (packing.packed_texts(docs, VOCABULARY) if one_step else packing.packed(packing.pieces(docs, VOCABULARY))).collect()
    by_doc, by_sequence = {}, {}
    for r in out:
        assert 1 <= r.length <= 2048 and zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    counts = {}
    for i, _ in texts():
        counts[i] = counts.get(i, 0) + 1
    for i, t in texts():
        if counts[i] > 1:
            continue
        want = library.encode(t or "", add_special_tokens=False).ids + [0]
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and [r.start for r in own] == [2048 * k for k in range(len(own))]
        assert np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist() == want
    total = sum(r.length for r in out)
    assert len(by_sequence) <= -(-total // 2048) + 1


def test_empty_table(spark):
    assert packing.packed(packing.pieces(documents(spark, []), VOCABULARY, with_ids=False)).count() == 0
