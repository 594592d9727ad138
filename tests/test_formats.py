import pytest

from docloom.sources import formats
from docloom.sources.formats import pdf_crypt
from docloom.sources.formats import DEFAULT, Eml, Epub, Image, LegacyOffice, Msg, OfficeOpenXml, OpenDocument, Pdf, PlainText, Rtf, chosen
from tests import builders as b

BACK = chr(92)


def test_plain_text_by_its_mark():
    t = PlainText()
    assert t.extract("a.txt", "ünï".encode()).text == "ünï" and t.extract("a.txt", b"\xef\xbb\xbfx").text == "x"
    assert t.extract("a.txt", "﻿hé".encode("utf-16-le")).text == "hé" and t.extract("a.txt", "﻿hé".encode("utf-32-be")).text == "hé"
    assert t.extract("a.xml", b"<a>1</a>\xff").text == "<a>1</a>�"


@pytest.mark.parametrize("source, want", [
    (r"{\rtf1\ansi{\fonttbl{\f0 Arial;}}Hello \b World\b0\par next}", "Hello World\nnext"), (r"{\rtf1 caf\'e9 a\{b\}\\c}", "café a{b}\\c"), (r"{\rtf1 x{\*\gen junk {nested}}y\tab z}", "xy z"),
    ("{" + BACK + "rtf1" + BACK + "uc1 " + BACK + "u8364?5 " + BACK + "u-3913?}", "€5 "), ("{" + BACK + "rtf1" + BACK + "uc2 " + BACK + "u233" + BACK + "'65" + BACK + "'65x}", "éx"),
    (r"{\rtf1 a\emdash b\~c\_d\bullet\cell e\lquote f\rquote}", "a—b c-d• e‘f’"), (r"{\rtf1{\header no}yes{\info{\title T}}}", "yes"), ("plain\r\ntext", "plaintext"), (r"{\rtf1 open\par", "open"), ("\\", ""),
])
def test_rtf(source, want):
    found = Rtf().extract("a.rtf", source.encode())
    assert found.text == want and found.metadata == {}


def test_ooxml():
    o = OfficeOpenXml()
    assert o.extract("a.docx", b.docx("Hello", "world &amp; all")) == ({"Title": "The Title", "Author": "Jane"}, "Hello world & all")
    assert o.extract("a.PPTX", b.pptx({"slide2": "two", "slide10": "ten", "slide1": "one"})).text == "one ten two"
    assert o.extract("a.xlsx", b.xlsx("a", "b")).text == "a b"
    assert o.extract("a.docx", b.zipped(x="y")) == ({}, "")
    with pytest.raises(Exception):
        o.extract("a.docx", b"not a zip")


def test_open_document_and_epub():
    body = "<text:h>Head</text:h><x><text:p>one <y>two</y><text:p>nested</text:p></text:p></x><text:p/>"
    assert OpenDocument().extract("a.odt", b.odt(body)) == ({"Title": "T"}, "Head\none twonested\n")
    assert Epub().extract("a.epub", b.epub()) == ({"Title": "Book", "Author": "Ann"}, "One\nFirst & best\nSecond\nline")
    assert Epub().extract("a.epub", b.zipped(x="y")) == ({}, "")
    assert Epub.resolved("a/b", "../../../c/./d.x#f") == "c/d.x"


def eml(head, body):
    return (head.strip().replace("\n", "\r\n") + "\r\n\r\n" + body.replace("\n", "\r\n")).encode("latin-1")


def test_mail_headers():
    found = Eml().extract("a.eml", eml("From: =?utf-8?B?SsO8cmc=?= <a@b.c>\nSubject: Hi\n  there\nsubject: second\nDate: Mon, 1\nTo: =?x?Q?a_=C3=A9?=\nCc: =?utf-8?B?!!?=", "body\n"))
    assert found == ({"From": "Jürg <a@b.c>", "To": "a é", "Cc": "=?utf-8?B?!!?=", "Subject": "Hi there", "Date": "Mon, 1"}, "body")


def test_mail_bodies():
    two = "--x\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: quoted-printable\n\ncaf=C3=A9=\n! =ZZ\n--x\nContent-Type: text/html\n\n<b>no</b>\n--x\nContent-Type: text/plain\nContent-Disposition: Attachment; filename=a\n\nhidden\n--x\nContent-Type: image/png\n\nraw\n--x--\nafter"
    assert Eml().extract("a.eml", eml('Content-Type: multipart/mixed; boundary="x"', two)).text == "café! =ZZ"
    assert Eml().extract("a.eml", eml("Content-Type: text/html", "<b>kept</b>")).text == "<b>kept</b>"
    assert Eml().extract("a.eml", eml("Content-Transfer-Encoding: base64", "aGVs\nbG8=")).text == "hello"
    assert Eml().extract("a.eml", eml("Content-Transfer-Encoding: base64", "not base64!")).text == "not base64!"
    assert Eml().extract("a.eml", eml("Content-Type: text/plain; charset=windows-1252", "é")).text == "é"
    assert Eml().extract("a.eml", eml("Content-Type: text/plain; charset=nonsense", "x")).text == "x"
    assert Eml().extract("a.eml", eml("Content-Type: multipart/mixed", "x")).text == ""
    assert Eml().extract("a.eml", b"Subject: only head") == ({"Subject": "only head"}, "")


def test_outlook_message():
    data = b.msg(**{"0037": ("001F", "Hi é"), "0C1A": ("001E", "Jane"), "5D01": ("001F", "j@x.org"), "0E04": ("001F", "Bob\0"), "1000": ("001F", "line\r\ntwo" + " long" * 900), "when": 132_223_104_000_000_000})
    found = Msg().extract("a.msg", data)
    assert found.metadata == {"From": "Jane <j@x.org>", "To": "Bob", "Subject": "Hi é", "Date": "2020-01-01T00:00:00Z"} and found.text.startswith("line\ntwo long") and len(found.text) > 4500
    assert Msg().extract("a.msg", b.msg(**{"0C1F": ("001F", "only@addr")})).metadata == {"From": "only@addr"}
    for bad in (b"", b"x" * 600):
        with pytest.raises(ValueError):
            Msg().extract("a.msg", bad)


def test_legacy_office():
    o = LegacyOffice()
    found = o.extract("a.doc", b.doc([("Hello\rnärrow\x07", True), ("wide ☃\x0bx", False)]))
    assert found == ({"Title": "Doc title", "Author": "Ann"}, "Hello\nnärrowwide ☃\nx")
    assert o.extract("a.doc", b.doc([("main text", True), ("footnote", True)], n_chars=9)).text == "main text"
    assert o.extract("a.xls", b.xls()).text == "wïde\nplain\nrich\ninline"
    assert o.extract("a.xls", b.xls(split=True)).text == "splitü\nplain\nrich\ninline"
    assert o.extract("a.PPT", b.ppt()).text == "Hello\nthere\nWörld\nx"
    assert o.extract("a.xls", b.compound({"Other": b"x"})).text == "" and o.extract("a.doc", b.compound({"WordDocument": b"\0" * 99})).text == ""
    utf8 = b.compound({"\x05SummaryInformation": b.summary(codepage=-535, title="Tïtle", subject=" ")})
    assert o.extract("a.xls", utf8).metadata == {"Title": "Tïtle"}


def test_images():
    want = {"Make": "Canon", "Model": "EOS 5D Mark", "Software": "v1"}
    for name, data in (("a.jpg", b.jpeg()), ("a.png", b.png()), ("a.tif", b.tiff())):
        assert Image().extract(name, data) == (want, "")
    assert Image().extract("a.gif", b"GIF89a...") == ({}, "")
    with pytest.raises(ValueError):
        Image().extract("a.jpg", b"nothing")


@pytest.mark.parametrize("compressed", [False, True])
def test_pdf(compressed):
    found = Pdf().extract("a.pdf", b.pdf(compressed))
    assert found.metadata == {"Title": "My (title)", "Author": "Me", "Pages": "2"} and found.text.split() == ["Hello", "World", "againABé"]
    with pytest.raises(ValueError):
        Pdf().extract("a.pdf", b"no")


@pytest.mark.parametrize("revision", [2, 3])
def test_pdf_under_an_empty_password(revision):
    found = Pdf().extract("a.pdf", b.locked_pdf(revision=revision))
    assert found.metadata == {"Title": "Secret title", "Pages": "1"} and found.text.split() == ["Hidden", "words"]
    with pytest.raises(ValueError, match="password"):
        Pdf().extract("a.pdf", b.locked_pdf(b"key", revision))


def test_ciphers_by_their_published_vectors():
    assert pdf_crypt.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    for size, block in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        assert pdf_crypt.aes_cbc(bytes(range(size)), bytes(16) + bytes.fromhex(block)).hex() == "00112233445566778899aabbccddeeff"


def test_choice():
    class Own:
        def can_handle(self, extension):
            return extension in (".txt", ".zzz")

        def extract(self, name, data):
            return formats.Content({}, "own")

    assert isinstance(chosen(".txt"), PlainText) and isinstance(chosen(".txt", (Own(),)), Own) and isinstance(chosen(".zzz", (Own(),)), Own)
    assert chosen(".bin") is None and chosen("") is None and chosen(".msg", default=DEFAULT) is None
    for ext in ".pdf .docx .pptx .xlsx .html .htm .rtf .txt .md .csv .log .json .xml .jpg .png .eml .msg .odt .ods .odp .epub .doc .xls .ppt".split():
        assert chosen(ext) is not None
