"""Token ids of whole texts by the files of public tokenizers, with a memory for the pieces of texts.

A tokenizer first cuts a text at fixed places and merges bytes only between them. A text
is cut here at some of those places by one pass of a byte pattern; each distinct piece is
given to the tokenizers library once and its ids are remembered. The result is the ids
that the library gives for the whole text.
"""

from __future__ import annotations

import ctypes
import gc
import json
import os
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa

#: Pieces of at most so many bytes are remembered, and as many of them, in two generations of half as many: a worker's memory is bounded whatever the texts.
LONGEST, REMEMBERED = 64, 1_200_000

_STOP = rb"(?=[\s!-&(-@\[-`{-~]|\Z)"
#: Bytes that begin a white space character beyond ASCII; such texts go to the library whole.
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: Letters up to a place where any letter run ends; signs up to a letter or digit; otherwise all up to white space. An apostrophe, a byte beyond ASCII and a control character end no piece.
_SPACED = re.compile(
    rb" ?[A-Za-z]++" + _STOP + rb"| ?[!-&(-/:-@\[-`{-~]++(?=[A-Za-z0-9\s]|\Z)| ?\S+|\s+(?!\S)|\s+"
)
_BARE = re.compile(rb"[A-Za-z]++" + _STOP + rb"|[!-&(-/:-@\[-`{-~]++(?=[A-Za-z0-9\s]|\Z)|\S+")
#: Control characters that the patterns above and the library may not class alike.
_CONTROL = re.compile(rb"[\x00-\x08\x0e-\x1f\x7f]")


class _Memory(dict):
    """Piece to ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, encode: Callable[[bytes], bytes], most: int) -> None:
        super().__init__()
        self.encode, self.old, self.half = encode, {}, most // 2

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.encode(piece)
            if len(piece) > LONGEST:
                return ids
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


@lru_cache(maxsize=4)
def encoder(vocabulary: str, special_as_text: bool = True, remembered: int = REMEMBERED) -> Callable[[bytes], bytes]:
    """A function from the UTF-8 bytes of a text to its ids as little-endian unsigned 32-bit integers.

    No special tokens are added. With special_as_text their strings in a text are ordinary
    text, as the files' own README has it, so that no text can bring in a control token;
    without, they are those tokens, as by the library's default. One encoder is kept for each
    file in a worker.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.encode_special_tokens = special_as_text
    with open(vocabulary, encoding="utf-8") as file:
        described = json.load(file)
    bare, spaced = _kind(described)

    def library(piece: bytes) -> bytes:
        ids = tokenizer.encode(piece.decode("utf-8", "replace"), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    if not (bare or spaced):
        return library
    added = [] if special_as_text else [t["content"].encode() for t in described["added_tokens"]]
    special = re.compile(b"|".join(map(re.escape, added)), re.IGNORECASE).search if added else lambda _: None
    letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
    model = tokenizer.model
    plain = re.compile(rb" ?(?:[A-Za-z]+|[!-&(-/:-@\[-`{-~]+)\Z" if spaced else rb"(?:[A-Za-z]+|[!-&(-/:-@\[-`{-~]+)\Z").match

    def once(piece: bytes) -> bytes:
        if not plain(piece):
            return library(piece)
        written = (piece.decode("ascii") if spaced else piece.decode("ascii").lower()).translate(letters)
        ids = [t.id for t in model.tokenize(written)]
        return struct.pack(f"<{len(ids)}I", *ids)

    memory = _Memory(once, remembered)
    get, cut = memory.__getitem__, (_SPACED if spaced else _BARE).findall

    def encode(text: bytes) -> bytes:
        if _CONTROL.search(text) or special(text) or spaced and not text.isascii() and _WIDE_SPACE.search(text):
            return library(text)
        return b"".join(map(get, cut(text)))

    return encode


def top_id(vocabulary: str) -> int:
    """The highest id of the file, added tokens included."""
    with open(vocabulary, encoding="utf-8") as file:
        described = json.load(file)
    words = described["model"]["vocab"]
    known = words.values() if isinstance(words, dict) else range(len(words))
    return max([0, *known, *(t["id"] for t in described.get("added_tokens") or ())])


def forget() -> None:
    """Gives up what this worker remembers, for a task that needs the room; tasks that tokenize begin anew."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        trim()


def trim() -> None:
    """Gives memory that this worker no longer uses back to the system: workers live on between stages."""
    gc.collect()
    if back := getattr(ctypes.CDLL(None), "malloc_trim", None):
        back(0)


def _kind(described: dict) -> tuple[bool, bool]:
    """Whether the file cuts words without their spaces, or with one space before them; otherwise texts go to the library whole."""
    pre, normal = described.get("pre_tokenizer") or {}, described.get("normalizer")
    if described["model"].get("type") != "BPE" or described["model"].get("dropout") or described["model"].get("ignore_merges"):
        return False, False
    spaced = normal is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    steps = pre.get("pretokenizers") or [{}]
    bare = (
        [n.get("type") for n in (normal or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        and len(steps) == 2
        and steps[0].get("behavior") == "Removed"
        and bool(steps[0].get("invert"))
        and steps[0].get("pattern", {}).get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        and steps[1].get("type") == "ByteLevel"
        and not steps[1].get("use_regex", True)
    )
    return bool(bare), bool(spaced)


def each(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; null is as empty."""
    for text in column.cast(pa.binary()):
        yield text.as_py() or b""


def path(name: str) -> str:
    """Where the file of a public tokenizer lies; its place is a parameter of all operators."""
    import public_tokenizers

    return public_tokenizers.path(name)
