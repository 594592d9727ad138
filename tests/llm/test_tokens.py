import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docloom.llm import tokens

PARTS = ["a", "B", "foo", "'s", "'ll", "'", "é", "é", " ", "  ", "\n", "\t", "\r\n", ",", ".", "!!", "12", "—", " ", " ", "　", "Σ", "İ", "ß", "😀", "中", "\x00", "\x1c", "\x85", "<|endoftext|>", "<|StartOfText|>", "_", "²", "̀", "don't", "I'LL"]


@pytest.mark.parametrize("as_text", [True, False])
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_librarys(name, as_text):
    encode, library = tokens.encoder(tokens.path(name), as_text), Tokenizer.from_file(tokens.path(name))
    library.encode_special_tokens = as_text

    @given(st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=4)), max_size=12).map("".join))
    @settings(max_examples=800, deadline=None)
    def check(text):
        text = text.encode("utf-8", "ignore").decode()
        assert np.frombuffer(encode(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids

    check()


def test_a_full_memory_forgets_in_two_generations():
    calls = []
    memory = tokens._Memory(lambda p: calls.append(p) or p, 8)
    for p in [b"%d" % k for k in range(20)] + [b"19", b"18"]:
        assert memory[p] == p
    assert calls.count(b"19") == 1 and len(memory) <= 8


def test_long_pieces_are_not_remembered():
    memory = tokens._Memory(lambda p: p, 100)
    assert memory[b"x" * tokens.LONGEST] and memory[b"y" * (tokens.LONGEST + 1)] and list(memory) == [b"x" * tokens.LONGEST]


def test_forgetting_changes_no_ids():
    name = tokens.path("byte_bpe_50k.json")
    before = tokens.encoder(name)(b"some words, and more")
    tokens.forget()
    assert tokens.encoder(name)(b"some words, and more") == before
