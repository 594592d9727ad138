"""Make, Model and Software of pictures, from the first directory of their EXIF data."""

from __future__ import annotations

import struct

from docloom.sources.formats.base import Content, properties

EXTENSIONS = frozenset(".jpg .jpeg .png .tiff .tif .heic .webp .gif .bmp".split())
_TAGS = {0x10F: "Make", 0x110: "Model", 0x131: "Software"}


def tiff_tags(data: bytes) -> dict[str, str]:
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None or len(data) < 8:
        return {}
    found: dict[str, str] = {}
    (at,) = struct.unpack_from(order + "I", data, 4)
    if at + 2 > len(data):
        return {}
    (n,) = struct.unpack_from(order + "H", data, at)
    for entry in range(at + 2, min(at + 2 + 12 * n, len(data) - 11), 12):
        tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
        if tag in _TAGS and kind == 2:
            first = entry + 8 if count <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
            found[_TAGS[tag]] = data[first : first + count].split(b"\0")[0].decode("utf-8", "replace")
    return properties(**found)


def exif_of(data: bytes) -> bytes:
    """The EXIF block of a picture of any known kind; empty if it has none."""
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xD9, 0xDA):
            (size,) = struct.unpack_from(">H", data, at + 2)
            if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return data[at + 10 : at + 2 + size]
            at += 2 + size
    elif data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(data):
            (size,) = struct.unpack_from(">I", data, at)
            if data[at + 4 : at + 8] == b"eXIf":
                return data[at + 8 : at + 8 + size]
            at += 12 + size
    elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        at = 12
        while at + 8 <= len(data):
            (size,) = struct.unpack_from("<I", data, at + 4)
            if data[at : at + 4] == b"EXIF":
                return data[at + 8 : at + 8 + size].removeprefix(b"Exif\0\0")
            at += 8 + size + size % 2
    elif data[:4] in (b"II*\0", b"MM\0*"):
        return data
    elif data[4:8] == b"ftyp":
        at = data.find(b"Exif\0\0")
        return data[at + 6 :] if at >= 0 else b""
    return b""


class Image:
    def can_handle(self, extension: str) -> bool:
        return extension in EXTENSIONS

    def extract(self, name: str, data: bytes) -> Content:
        known = data[:2] in (b"\xff\xd8", b"BM") or data[:4] in (b"\x89PNG", b"RIFF", b"GIF8", b"II*\0", b"MM\0*") or data[4:8] == b"ftyp"
        if not known:
            raise ValueError("not a picture of a known kind")
        return Content(tiff_tags(exif_of(data)), "")
