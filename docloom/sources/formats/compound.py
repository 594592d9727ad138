"""Formats in OLE compound files: Outlook messages and the binary Office documents."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import datetime, timedelta

from docloom.sources.formats.base import Content, properties

_END = 0xFFFFFFFC  # sectors from here on are marks, not places


class CompoundFile:
    """All streams by name; of equal names the last. A leading control character may be left out when asking."""

    def __init__(self, data: bytes) -> None:
        if len(data) < 512 or data[:8] != bytes.fromhex("d0cf11e0a1b11ae1"):
            raise ValueError("not an OLE compound file")
        self.data = data
        big, small = struct.unpack_from("<HH", data, 30)
        self.sector, self.mini = 1 << big, 1 << small
        (directory,) = struct.unpack_from("<I", data, 48)
        cutoff, mini_table = struct.unpack_from("<II", data, 56)
        more, n_more = struct.unpack_from("<II", data, 68)
        tables = [s for s in struct.unpack_from("<109I", data, 76) if s < _END]
        seen = set()
        while n_more and more < _END and more not in seen:
            seen.add(more)
            *own, more = self._numbers(self._at(more))
            tables += [s for s in own if s < _END]
        self.next = [n for s in tables for n in self._numbers(self._at(s))]
        entries = self._chain(directory)
        mini_next = self._numbers(self._chain(mini_table))
        self.streams: dict[str, bytes] = {}
        container = b""
        for at in range(0, len(entries) - 127, 128):
            length, kind = struct.unpack_from("<HB", entries, at + 64)
            start, size = struct.unpack_from("<II", entries, at + 116)
            if at == 0:
                container = self._chain(start)[:size]
            if kind != 2 or length <= 2:
                continue
            name = entries[at : at + length - 2].decode("utf-16-le", "replace")
            own = b"".join(self._small(container, mini_next, start)) if size < cutoff else self._chain(start)
            self.streams[name] = own[:size]
            if len(name) > 1 and name[0] < " ":
                self.streams[name[1:]] = own[:size]

    def _at(self, sector: int) -> bytes:
        first = (sector + 1) * self.sector
        if first + self.sector > len(self.data):
            raise ValueError("a sector lies beyond the end of the file")
        return self.data[first : first + self.sector]

    @staticmethod
    def _numbers(data: bytes) -> tuple[int, ...]:
        return struct.unpack_from(f"<{len(data) // 4}I", data)

    def _walk(self, start: int, following: tuple[int, ...] | list[int]) -> Iterator[int]:
        for _ in range(len(following) + 1):
            if start >= len(following):
                return
            yield start
            start = following[start]

    def _chain(self, start: int) -> bytes:
        return b"".join(self._at(s) for s in self._walk(start, self.next))

    def _small(self, container: bytes, following: tuple[int, ...], start: int) -> Iterator[bytes]:
        for s in self._walk(start, following):
            piece = container[s * self.mini : (s + 1) * self.mini]
            if len(piece) < self.mini:
                return
            yield piece

    def get(self, *names: str) -> bytes | None:
        return next((self.streams[n] for n in names if n in self.streams), None)


class Msg:
    def can_handle(self, extension: str) -> bool:
        return extension == ".msg"

    @staticmethod
    def _text(file: CompoundFile, tag: str) -> str | None:
        if (wide := file.get(f"__substg1.0_{tag}001F")) is not None:
            return wide.decode("utf-16-le", "replace").rstrip("\0")
        narrow = file.get(f"__substg1.0_{tag}001E")
        return None if narrow is None else narrow.decode("latin-1").rstrip("\0")

    @staticmethod
    def _date(file: CompoundFile) -> str | None:
        """When it was submitted, else delivered."""
        table, times = file.get("__properties_version1.0") or b"", {}
        for at in range(32, len(table) - 15, 16):
            kind, tag = struct.unpack_from("<HH", table, at)
            if kind == 0x40:
                (times[tag],) = struct.unpack_from("<q", table, at + 8)
        ticks = times.get(0x39) or times.get(0xE06) or 0
        if ticks <= 0:
            return None
        try:
            return (datetime(1601, 1, 1) + timedelta(microseconds=ticks // 10)).strftime("%Y-%m-%dT%H:%M:%SZ")
        except OverflowError:
            return None

    def extract(self, name: str, data: bytes) -> Content:
        file = CompoundFile(data)
        who, address = self._text(file, "0C1A"), self._text(file, "5D01")
        address = self._text(file, "0C1F") if address is None else address
        both = who and who.strip() and address and address.strip()
        sender = f"{who.strip()} <{address.strip()}>" if both else address if who is None else who
        found = properties(From=sender, To=self._text(file, "0E04"), Cc=self._text(file, "0E03"), Subject=self._text(file, "0037"), Date=self._date(file))
        return Content(found, (self._text(file, "1000") or "").replace("\r\n", "\n").strip())


def summary(file: CompoundFile) -> dict[str, str]:
    """Title, Author and Subject of the first property set."""
    data = file.get("SummaryInformation") or b""
    if len(data) < 48:
        return {}
    (base,) = struct.unpack_from("<I", data, 44)
    if base + 8 > len(data):
        return {}
    (n,) = struct.unpack_from("<I", data, base + 4)
    places = {}
    for at in range(base + 8, min(base + 8 + 8 * n, len(data) - 7), 8):
        key, offset = struct.unpack_from("<II", data, at)
        places[key] = base + offset
    page = 0
    if (at := places.get(1)) is not None and at + 6 <= len(data) and struct.unpack_from("<I", data, at)[0] == 2:
        (page,) = struct.unpack_from("<H", data, at + 4)

    def text(key: int) -> str | None:
        at = places.get(key)
        if at is None or at + 8 > len(data):
            return None
        kind, length = struct.unpack_from("<Ii", data, at)
        if length <= 0:
            return None
        if kind == 30:
            own = data[at + 8 : at + 8 + length].rstrip(b"\0")
            return own.decode("utf-8" if page == 65001 else "latin-1", "replace") or None
        if kind == 31:
            own = data[at + 8 : at + 8 + 2 * length]
            return own[: len(own) // 2 * 2].decode("utf-16-le", "replace").rstrip("\0") or None
        return None

    return properties(Title=text(2), Author=text(4), Subject=text(3))


def word_text(file: CompoundFile) -> str:
    """The main text of a .doc by its piece table."""
    main = file.get("WordDocument") or b""
    if len(main) < 96 or main[:2] != b"\xec\xa5":
        return ""
    names = ("1Table", "0Table") if struct.unpack_from("<H", main, 10)[0] & 0x200 else ("0Table", "1Table")
    table = file.get(*names)
    if table is None:
        return ""
    longs = 36 + 2 * struct.unpack_from("<H", main, 32)[0]
    if longs + 16 > len(main):
        return ""
    n_longs, (n_chars,) = struct.unpack_from("<H", main, longs - 2)[0], struct.unpack_from("<I", main, longs + 12)
    pair = longs + 4 * n_longs + 2 + 33 * 8
    if pair + 8 > len(main):
        return ""
    at, size = struct.unpack_from("<ii", main, pair)
    if at < 0 or size <= 0 or at + size > len(table):
        return ""
    own = table[at : at + size]
    while own[:1] == b"\x01" and len(own) >= 3:
        own = own[3 + struct.unpack_from("<H", own, 1)[0] :]
    if own[:1] != b"\x02" or len(own) < 5:
        return ""
    pieces = own[5 : 5 + struct.unpack_from("<I", own, 1)[0]]
    n = (len(pieces) - 4) // 12
    if n <= 0:
        return ""
    ends, out = struct.unpack_from(f"<{n + 1}i", pieces), []
    for k in range(n):
        if ends[k] >= n_chars:
            break
        (place,) = struct.unpack_from("<I", pieces, 4 * (n + 1) + 8 * k + 2)
        length, first = max(0, min(ends[k + 1], n_chars) - ends[k]), place & 0x3FFFFFFF
        if place & 0x40000000:
            out.append(main[first // 2 : first // 2 + length].decode("latin-1"))
        else:
            raw = main[first : first + 2 * length]
            out.append(raw[: len(raw) // 2 * 2].decode("utf-16-le", "surrogatepass"))
    breaks = {c: "\n" for c in (10, 11, 12, 13)} | {c: None for c in range(32) if c not in (9, 10, 11, 12, 13)}
    return "".join(out).translate(breaks).encode("utf-16", "surrogatepass").decode("utf-16", "replace").strip()


class _Cells:
    """The shared strings of a .xls: bytes of one record and those that continue it."""

    def __init__(self, data: bytes, cuts: set[int]) -> None:
        self.data, self.cuts, self.at = data, cuts, 8

    def _take(self, layout: str) -> int:
        (value,) = struct.unpack_from(layout, self.data, self.at)
        self.at += struct.calcsize(layout)
        return value

    def string(self) -> str:
        length, flags, out = self._take("<H"), self._take("<B"), []
        runs = self._take("<H") if flags & 8 else 0
        extra = self._take("<I") if flags & 4 else 0
        wide = flags & 1
        for _ in range(length):
            if self.at in self.cuts and self.at < len(self.data):
                wide = self._take("<B") & 1
            if self.at + 1 + wide > len(self.data):
                break
            out.append(chr(self._take("<H" if wide else "<B")))
        self.at += 4 * runs + extra
        return "".join(out)

    def all(self) -> list[str]:
        if len(self.data) < 8:
            return []
        (n,), out = struct.unpack_from("<I", self.data, 4), []
        while len(out) < n and self.at + 3 <= len(self.data):
            out.append(self.string())
        return out


def _records(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 4 <= len(data):
        kind, length = struct.unpack_from("<HH", data, at)
        if at + 4 + length > len(data):
            return
        yield kind, data[at + 4 : at + 4 + length]
        at += 4 + length


def sheet_text(file: CompoundFile) -> str:
    """The text cells of a .xls in the order of their records."""
    book = file.get("Workbook", "Book")
    if book is None:
        return ""
    records = list(_records(book))
    shared: list[str] = []
    for k, (kind, body) in enumerate(records):
        if kind == 0xFC:
            cuts = set()
            for following, more in records[k + 1 :]:
                if following != 0x3C:
                    break
                cuts.add(len(body))
                body += more
            shared = _Cells(body, cuts).all()
            break
    cells = []
    for kind, body in records:
        if kind == 0xFD and len(body) >= 10:
            (n,) = struct.unpack_from("<i", body, 6)
            cells.append(shared[n] if 0 <= n < len(shared) else "")
        elif kind == 0x204 and len(body) >= 9:
            length, flags = struct.unpack_from("<HB", body, 6)
            raw = body[9 : 9 + length * (1 + (flags & 1))]
            cells.append(raw[: len(raw) // 2 * 2].decode("utf-16-le", "replace") if flags & 1 else raw.decode("latin-1"))
    return "\n".join(c for c in cells if c).strip()


def slide_text(file: CompoundFile) -> str:
    """The text atoms of a .ppt in the order of its record tree."""
    out: list[str] = []

    def walk(data: bytes) -> None:
        at = 0
        while at + 8 <= len(data):
            version, kind, length = struct.unpack_from("<HHi", data, at)
            if length < 0 or at + 8 + length > len(data):
                return
            body = data[at + 8 : at + 8 + length]
            if version & 15 == 15:
                walk(body)
            elif kind in (4000, 4008):
                text = body.decode("latin-1") if kind == 4008 else body.decode("utf-16-le", "replace")
                out.append(text.translate({11: "\n", 13: "\n", 0: None}))
            at += 8 + length

    walk(file.get("PowerPoint Document") or b"")
    return "\n".join(t for t in out if t).strip()


class LegacyOffice:
    readers = {".doc": word_text, ".xls": sheet_text, ".ppt": slide_text}

    def can_handle(self, extension: str) -> bool:
        return extension in self.readers

    def extract(self, name: str, data: bytes) -> Content:
        file = CompoundFile(data)
        return Content(summary(file), self.readers[name.lower()[-4:]](file))
