"""Extractors of text and metadata from the bytes of files."""

from docloom.sources.formats.base import Content, Extractor
from docloom.sources.formats.compound import LegacyOffice, Msg
from docloom.sources.formats.image import Image
from docloom.sources.formats.mail import Eml
from docloom.sources.formats.markup import Html, PlainText, Rtf
from docloom.sources.formats.pdf import Pdf
from docloom.sources.formats.zipped import Epub, OfficeOpenXml, OpenDocument

#: In the order in which they are asked, after the caller's own.
DEFAULT = (Pdf(), OfficeOpenXml(), Html(), Rtf(), PlainText(), Image())
#: Formats of the add-ons.
ADDED = (Eml(), Msg(), OpenDocument(), Epub(), LegacyOffice())


def chosen(extension: str, own: tuple | list = (), default: tuple = DEFAULT + ADDED) -> Extractor | None:
    """The first that takes the extension, the caller's before the built-in ones."""
    return next((e for e in (*own, *default) if e.can_handle(extension)), None)


__all__ = ["ADDED", "DEFAULT", "Content", "Eml", "Epub", "Extractor", "Html", "Image", "LegacyOffice", "Msg", "OfficeOpenXml", "OpenDocument", "Pdf", "PlainText", "Rtf", "chosen"]
