"""What an extractor is, and the small tools that several share."""

from __future__ import annotations

import re
from html.entities import entitydefs
from typing import NamedTuple, Protocol, runtime_checkable


class Content(NamedTuple):
    metadata: dict[str, str]
    text: str


@runtime_checkable
class Extractor(Protocol):
    """can_handle takes a lower-case extension with its dot. An extractor is picklable, and may raise on a bad file."""

    def can_handle(self, extension: str) -> bool: ...

    def extract(self, name: str, data: bytes) -> Content: ...


def properties(**found: str | None) -> dict[str, str]:
    """Those that are not blank, trimmed, in the given order."""
    return {k: v.strip() for k, v in found.items() if v and v.strip()}


_MARKS = ((b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))


def decoded(data: bytes) -> str:
    """By the byte order mark, else as UTF-8; bytes that are neither become U+FFFD."""
    for mark, name in _MARKS:
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    return data.decode("utf-8", "replace")


#: The named entities of HTML 4 and apos, without those that newer pages know.
ENTITIES = {**entitydefs, "apos": "'"}
_ENTITY = re.compile(r"&(?:#(?:[xX]([0-9A-Fa-f]+)|([0-9]+))|([0-9A-Za-z]+));")


def unescaped(text: str) -> str:
    """One pass over entities that end in a semicolon; unknown ones and bad numbers stay."""

    def one(m: re.Match[str]) -> str:
        if m[3]:
            return ENTITIES.get(m[3], m[0])
        code = int(m[1], 16) if m[1] else int(m[2])
        return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    return _ENTITY.sub(one, text)
