"""Formats that are XML in a zip file: OOXML, OpenDocument and EPUB."""

from __future__ import annotations

import io
import re
import zipfile
from urllib.parse import unquote
from xml.etree import ElementTree

from docloom.sources.formats.base import Content, decoded, properties
from docloom.sources.formats.markup import block_text

_DC = "{http://purl.org/dc/elements/1.1/}"
_OOXML = "{http://schemas.openxmlformats.org/%s/2006/main}t"
_OFFICE = "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}"
_TEXT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
_PACKAGE = "{http://www.idpf.org/2007/opf}"
_CONTAINER = "{urn:oasis:names:tc:opendocument:xmlns:container}"


class _Zip:
    def __init__(self, data: bytes) -> None:
        self.file = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.file.namelist())

    def raw(self, name: str) -> bytes | None:
        return self.file.read(name) if name in self.names else None

    def xml(self, name: str) -> ElementTree.Element | None:
        data = self.raw(name)
        return None if data is None else ElementTree.fromstring(data)


def _all_text(e: ElementTree.Element) -> str:
    return "".join(e.itertext())


def _core(root: ElementTree.Element | None) -> dict[str, str]:
    if root is None:
        return {}

    def first(tag: str) -> str | None:
        found = next(root.iter(_DC + tag), None)
        return None if found is None else _all_text(found)

    return properties(Title=first("title"), Author=first("creator"), Subject=first("subject"))


def _culture_order(name: str) -> tuple[str, str]:
    """Letters without regard to case first, so slide10 comes before slide2."""
    return name.casefold(), name


class OfficeOpenXml:
    def can_handle(self, extension: str) -> bool:
        return extension in (".docx", ".pptx", ".xlsx")

    def extract(self, name: str, data: bytes) -> Content:
        box, lower = _Zip(data), name.lower()
        if lower.endswith(".docx"):
            parts, kind, gap = ["word/document.xml"], "wordprocessingml", " "
        elif lower.endswith(".xlsx"):
            parts, kind, gap = ["xl/sharedStrings.xml"], "spreadsheetml", " "
        else:
            parts = sorted((n for n in box.names if re.match(r"(?is)ppt/slides/slide.*\.xml\Z", n)), key=_culture_order)
            kind, gap = "drawingml", " "
        roots = [root for part in parts if (root := box.xml(part)) is not None]
        return Content(_core(box.xml("docProps/core.xml")), gap.join(_all_text(e) for root in roots for e in root.iter(_OOXML % kind)))


class OpenDocument:
    blocks = (_TEXT + "p", _TEXT + "h")

    def can_handle(self, extension: str) -> bool:
        return extension in (".odt", ".ods", ".odp")

    def _outermost(self, e: ElementTree.Element) -> list[str]:
        found = []
        for child in e:
            found += [_all_text(child)] if child.tag in self.blocks else self._outermost(child)
        return found

    def extract(self, name: str, data: bytes) -> Content:
        box = _Zip(data)
        root = box.xml("content.xml")
        body = next(root.iter(_OFFICE + "body"), None) if root is not None else None
        return Content(_core(box.xml("meta.xml")), "" if body is None else "\n".join(self._outermost(body)))


class Epub:
    def can_handle(self, extension: str) -> bool:
        return extension == ".epub"

    @staticmethod
    def resolved(folder: str, href: str) -> str:
        """The entry that a link of the package file means."""
        out: list[str] = []
        for part in f"{folder}/{unquote(href).split('#', 1)[0]}".split("/"):
            if part == "..":
                del out[-1:]
            elif part not in ("", "."):
                out.append(part)
        return "/".join(out)

    def extract(self, name: str, data: bytes) -> Content:
        box = _Zip(data)
        container = box.xml("META-INF/container.xml")
        entry = next(container.iter(_CONTAINER + "rootfile"), None) if container is not None else None
        at = entry.get("full-path") if entry is not None else None
        package = box.xml(at) if at else None
        if package is None:
            return Content({}, "")
        links = {e.get("id"): e.get("href") for e in package.iter(_PACKAGE + "item") if e.get("id") is not None and e.get("href") is not None}
        folder, chapters = at.rpartition("/")[0], []
        for e in package.iter(_PACKAGE + "itemref"):
            page = box.raw(self.resolved(folder, links[e.get("idref")])) if e.get("idref") in links else None
            if page is not None and (text := block_text(decoded(page))):
                chapters.append(text)
        return Content(_core(package), "\n".join(chapters).strip())
