"""Internet messages, read leniently: a bad part costs no more than itself."""

from __future__ import annotations

import base64
import binascii
import codecs
import re
from collections.abc import Iterator

from docloom.sources.formats.base import Content, properties

_WORD = re.compile(r"=\?([^?]+)\?([BQbq])\?([^?]*)\?=")
_LATIN = frozenset("iso-8859-1 iso8859-1 latin1 windows-1252 cp1252".split())


def _divided(raw: str) -> tuple[str, str]:
    """Head and body; CRLF blank lines go before LF ones."""
    for gap in ("\r\n\r\n", "\n\n"):
        head, found, body = raw.partition(gap)
        if found:
            return head, body
    return raw, ""


def _fields(head: str) -> dict[str, str]:
    """By lower-case name; the first of equal names, continuation lines joined."""
    found: list[list[str]] = []
    open_ = False
    for line in head.split("\n"):
        line = line.rstrip("\r")
        if not line:
            continue
        if line[0] in " \t" and open_:
            found[-1][1] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        open_ = bool(colon)
        if open_:
            found.append([name.strip().lower(), value.strip()])
    return {k: v for k, v in reversed(found)}


def _media(value: str | None) -> tuple[str, dict[str, str]]:
    if not (value or "").strip():
        return "text/plain", {}
    kind, *rest = value.split(";")
    pairs = (p.partition("=") for p in rest if "=" in p)
    return kind.strip().lower(), {k.strip().lower(): v.strip().strip('"') for k, _, v in pairs if k.strip()}


def _parts(body: str, boundary: str) -> Iterator[str]:
    for part in body.split("--" + boundary)[1:]:
        if part.startswith("--"):
            return
        yield re.sub(r"\r?\n\Z", "", re.sub(r"\A\r?\n", "", part))


def _unquoted(text: str) -> bytes:
    """Quoted-printable; a stray equals sign stays."""
    one = re.sub(r"=(?:\r\n?|\n)", "", text)
    return re.sub(r"=([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), one).encode("latin-1", "replace")


def _base64(text: str) -> bytes:
    return base64.b64decode("".join(text.split()), validate=True)


def _charset(data: bytes, name: str | None) -> str:
    name = (name or "").strip().strip('"').lower()
    if name in _LATIN:
        return data.decode("latin-1")
    if name in ("us-ascii", "ascii"):
        return data.decode("ascii", "replace").replace("�", "?")
    try:
        codec = codecs.lookup(name or "utf-8").name
        return data.decode(codec, "replace")
    except (LookupError, TypeError, UnicodeError):
        return data.decode("utf-8", "replace")


def _words(value: str | None) -> str | None:
    """Encoded words in a header; those that do not decode stay."""

    def one(m: re.Match[str]) -> str:
        try:
            data = _base64(m[3]) if m[2] in "Bb" else _unquoted(m[3].replace("_", " "))
        except (binascii.Error, ValueError):
            return m[0]
        return _charset(data, m[1])

    return value and _WORD.sub(one, value)


class Eml:
    def can_handle(self, extension: str) -> bool:
        return extension == ".eml"

    def _leaves(self, fields: dict[str, str], body: str) -> Iterator[tuple[str, str]]:
        media, about = _media(fields.get("content-type"))
        if media.startswith("multipart/"):
            for part in _parts(body, about["boundary"]) if about.get("boundary") else ():
                head, rest = _divided(part)
                yield from self._leaves(_fields(head), rest)
        elif media.startswith("text/") and not fields.get("content-disposition", "").lstrip().lower().startswith("attachment"):
            way, data = fields.get("content-transfer-encoding", "").strip().lower(), body.encode("latin-1", "replace")
            if way == "quoted-printable":
                data = _unquoted(body)
            elif way == "base64":
                try:
                    data = _base64(body)
                except (binascii.Error, ValueError):
                    pass
            yield media, _charset(data, about.get("charset"))

    def extract(self, name: str, data: bytes) -> Content:
        head, body = _divided(data.decode("latin-1"))
        fields = _fields(head)
        leaves = list(self._leaves(fields, body))
        plain = [t for m, t in leaves if m != "text/html"] or [t for _, t in leaves]
        found = properties(**{k: _words(fields.get(k.lower())) for k in ("From", "To", "Cc", "Subject")}, Date=fields.get("date"))
        return Content(found, "".join(t + "\n" for t in plain).strip())
