"""Small files of each format, built in memory."""

import hashlib
import io
import struct
import zipfile
import zlib


def zipped(**parts):
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return box.getvalue()


CORE = '<cp:coreProperties xmlns:cp="urn:cp" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title> The Title </dc:title><dc:creator>Jane</dc:creator><dc:subject> </dc:subject></cp:coreProperties>'


def docx(*runs):
    body = "".join(f"<w:r><w:t>{r}</w:t></w:r>" for r in runs)
    return zipped(**{"word/document.xml": f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p>{body}</w:p></w:document>', "docProps/core.xml": CORE})


def pptx(slides):
    a = "http://schemas.openxmlformats.org/drawingml/2006/main"
    return zipped(**{f"ppt/slides/{name}.xml": f'<p xmlns:a="{a}"><a:t>{text}</a:t></p>' for name, text in slides.items()})


def xlsx(*strings):
    s = "".join(f"<si><t>{x}</t></si>" for x in strings)
    return zipped(**{"xl/sharedStrings.xml": f'<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">{s}</sst>'})


def odt(body):
    head = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:dc="http://purl.org/dc/elements/1.1/"'
    return zipped(**{"content.xml": f"<office:c {head}><office:body>{body}</office:body></office:c>", "meta.xml": f"<m {head}><dc:title>T</dc:title></m>"})


def epub():
    return zipped(**{
        "META-INF/container.xml": '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>',
        "OEBPS/book.opf": '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Book</dc:title><dc:creator>Ann</dc:creator></metadata>'
        '<manifest><item id="b" href="../text/two%20b.xhtml#x"/><item id="a" href="one.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/><itemref idref="zz"/></spine></package>',
        "OEBPS/one.xhtml": "<html><style>x</style><h1>One</h1><p>First &amp; best</p></html>", "text/two b.xhtml": "<p>Second</p><div>  line </div>",
    })


def compound(streams, mini=64):
    """An OLE file with 512-byte sectors: small streams in the mini stream, others in sectors of their own."""
    small = {n: d for n, d in streams.items() if len(d) < 4096}
    large = {n: d for n, d in streams.items() if len(d) >= 4096}
    pad = lambda d, k: d + b"\0" * (-len(d) % k)
    end, free = 0xFFFFFFFE, 0xFFFFFFFF
    mini_data, mini_fat, starts = b"", [], {}
    for n, d in small.items():
        first, k = len(mini_fat), max(1, -(-len(d) // mini))
        starts[n] = first
        mini_fat += [first + i + 1 for i in range(k - 1)] + [end]
        mini_data += pad(d or b"\0", mini)
    parts = [("minifat", pad(struct.pack(f"<{len(mini_fat)}I", *mini_fat), 4) + b"\xff" * 0), ("mini", mini_data), *large.items()]
    n_entries = 1 + len(streams)
    parts.insert(0, ("dir", b"\0" * (128 * n_entries)))
    sectors, at, first_of = [], 1, {}
    for n, d in parts:
        k = -(-len(d) // 512)
        first_of[n] = at if k else end
        sectors += [at + i + 1 for i in range(k - 1)] + ([end] if k else [])
        at += k
    fat = [0xFFFFFFFD, *sectors]
    fat += [free] * (128 - len(fat))
    assert len(fat) == 128, "one FAT sector is enough here"

    def entry(name, kind, start, size):
        raw = name.encode("utf-16-le") + b"\0\0"
        return pad(raw, 64)[:64] + struct.pack("<HBB", len(raw), kind, 0) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<IQ", start, size)

    entries = entry("Root Entry", 5, first_of["mini"], len(mini_data))
    for n, d in streams.items():
        entries += entry(n, 2, starts[n] if n in small else first_of[n], len(d))
    body = b"".join(pad(entries if n == "dir" else d, 512) for n, d in parts)
    header = bytes.fromhex("d0cf11e0a1b11ae1") + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6
    header += struct.pack("<IIIIIIIIII", 0, 1, first_of["dir"], 0, 4096, first_of["minifat"], 1 if mini_fat else 0, end, 0, 0)
    header += struct.pack("<108I", *[free] * 108)
    return header[:512].ljust(512, b"\xff") + struct.pack("<128I", *fat) + body


def msg(**properties):
    when = properties.pop("when", None)
    streams = {f"__substg1.0_{tag}{kind}": value.encode("utf-16-le" if kind == "001F" else "latin-1") for tag, (kind, value) in properties.items()}
    if when is not None:
        streams["__properties_version1.0"] = b"\0" * 32 + struct.pack("<HHIq", 0x40, 0x0E06, 6, when) + struct.pack("<HHIq", 3, 0x39, 6, 5)
    return compound(streams)


def summary(codepage=None, **texts):
    ids = {"title": 2, "subject": 3, "author": 4}
    values = [(1, struct.pack("<IhH", 2, codepage, 0))] if codepage is not None else []
    for k, v in texts.items():
        raw = v.encode("utf-8" if codepage == -535 else "latin-1") + b"\0"
        values.append((ids[k], struct.pack("<II", 30, len(raw)) + raw + b"\0" * (-len(raw) % 4)))
    table, body, at = b"", b"", 8 + 8 * len(values)
    for k, v in values:
        table += struct.pack("<II", k, at + len(body))
        body += v
    section = struct.pack("<II", at + len(body), len(values)) + table + body
    return struct.pack("<HHI", 0xFFFE, 0, 0) + b"\0" * 16 + struct.pack("<I", 1) + b"\0" * 16 + struct.pack("<I", 48) + section


def doc(pieces, n_chars=None):
    """pieces: (text, compressed)"""
    main, ends, places, chars = bytearray(0x400), [0], [], 0
    for text, narrow in pieces:
        raw = text.encode("latin-1" if narrow else "utf-16-le")
        places.append((len(main) * 2 | 0x40000000) if narrow else len(main))
        main += raw
        chars += len(text)
        ends.append(chars)
    plc = struct.pack(f"<{len(ends)}I", *ends) + b"".join(struct.pack("<HIH", 0, p, 0) for p in places)
    clx = b"\x01" + struct.pack("<H", 3) + b"abc" + b"\x02" + struct.pack("<I", len(plc)) + plc
    struct.pack_into("<H", main, 0, 0xA5EC)
    struct.pack_into("<H", main, 0x0A, 0x0200)
    struct.pack_into("<H", main, 32, 14)
    struct.pack_into("<H", main, 62, 22)
    struct.pack_into("<I", main, 64 + 12, chars if n_chars is None else n_chars)
    struct.pack_into("<II", main, 64 + 88 + 2 + 33 * 8, 7, len(clx))
    return compound({"WordDocument": bytes(main), "1Table": b"\0" * 7 + clx, "\x05SummaryInformation": summary(title="Doc title", author="Ann")})


def xls(split=False):
    def record(kind, body):
        return struct.pack("<HH", kind, len(body)) + body

    text = lambda t, wide: struct.pack("<HB", len(t), wide) + t.encode("utf-16-le" if wide else "latin-1")
    rich = struct.pack("<HBHI", 4, 0x0C, 1, 2) + b"rich" + b"\0" * 4 + b"\0" * 2
    head = struct.pack("<II", 4, 3)
    if split:
        sst = record(0xFC, head + text("plain", 0) + rich + struct.pack("<HB", 6, 0) + b"spl") + record(0x3C, b"\x01" + "itü".encode("utf-16-le"))
    else:
        sst = record(0xFC, head + text("plain", 0) + rich + text("wïde", 1))
    cells = b"".join(record(0xFD, struct.pack("<HHHI", 0, 0, 0, n)) for n in (2, 0, 1, 99)) + record(0x204, struct.pack("<HHH", 0, 0, 0) + text("inline", 0))
    return compound({"Workbook": record(0x809, b"\0" * 4) + sst + cells})


def ppt():
    atom = lambda kind, body: struct.pack("<HHI", 0, kind, len(body)) + body
    inner = atom(0x0FA8, b"Hello\rthere") + atom(0x0FA0, "Wörld\x0bx\0".encode("utf-16-le")) + atom(1, b"no")
    return compound({"PowerPoint Document": struct.pack("<HHI", 15, 1000, len(inner)) + inner})


def tiff(order="<"):
    texts = {0x10F: b"Canon\0", 0x110: b"EOS 5D Mark\0", 0x131: b"v1\0"}
    n, heap, entries = len(texts), b"", b""
    for tag, value in sorted(texts.items()):
        where = value.ljust(4, b"\0") if len(value) <= 4 else struct.pack(order + "I", 8 + 2 + 12 * n + 4 + len(heap))
        heap += b"" if len(value) <= 4 else value
        entries += struct.pack(order + "HHI", tag, 2, len(value)) + where
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "IH", 8, n) + entries + b"\0" * 4 + heap


def jpeg():
    block = b"Exif\0\0" + tiff()
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", len(block) + 2) + block + b"\xff\xda"


def png():
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13) + chunk(b"eXIf", tiff(">")) + chunk(b"IEND", b"")


def pdf(compressed=False, title=b"(My \\(title\\))"):
    content = b"BT /F1 12 Tf 72 700 Td (Hello) Tj 0 -20 Td [(Wor) -10 (ld) -500 (again)] TJ /F2 9 Tf <00010002> Tj ET"
    cmap = b"1 beginbfrange <0001> <0002> <00410042> endbfrange 1 beginbfchar <0002> <00E9> endbfchar"
    extra = b""
    if compressed:
        content, extra = zlib.compress(content), b"/Filter/FlateDecode"
    parts = [
        b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R 7 0 R]/Count 2/Resources<</Font<</F1 5 0 R/F2 6 0 R>>>>>>", b"<</Type/Page/Parent 2 0 R/Contents 4 0 R>>",
        b"<</Length %d%s>>stream\n%s\nendstream" % (len(content), extra, content), b"<</Type/Font/Subtype/Type1>>", b"<</Type/Font/Subtype/Type0/ToUnicode 9 0 R>>", b"<</Type/Page/Parent 2 0 R>>",
        b"<</Title %s/Author (Me)>>" % title, b"<</Length %d>>stream\n%s\nendstream" % (len(cmap), cmap),
    ]
    return b"%PDF-1.4\n" + b"\n".join(b"%d 0 obj%s\nendobj" % (k + 1, p) for k, p in enumerate(parts)) + b"\ntrailer<</Root 1 0 R/Info 8 0 R>>\n%%EOF"


def rc4(key, data):
    s, j, out = list(range(256)), 0, []
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) % 256
        s[i], s[j] = s[j], s[i]
    i = j = 0
    for c in data:
        i = (i + 1) % 256
        j = (j + s[i]) % 256
        s[i], s[j] = s[j], s[i]
        out.append(c ^ s[(s[i] + s[j]) % 256])
    return bytes(out)


def locked_pdf(password=b"", revision=3):
    """A page and a title under RC4, as the format's algorithms 1 to 5 have it; 128 bits from revision 3 on, else 40."""
    pad = bytes.fromhex("28bf4e5e4e758a4164004e56fffa01082e2e00b6d0683e802f0ca9fe6453697a")
    md5 = lambda x: hashlib.md5(x).digest()
    size, owner, one = (16 if revision > 2 else 5), bytes(range(32)), b"0123456789abcdef"
    key = md5((password + pad)[:32] + owner + struct.pack("<i", -44) + one)
    for _ in range(50 if revision > 2 else 0):
        key = md5(key[:size])
    key = key[:size]
    user = rc4(key, pad)
    if revision > 2:
        user = md5(pad + one)
        for k in range(20):
            user = rc4(bytes(x ^ k for x in key), user)
        user += b"\0" * 16
    hidden = lambda number, data: rc4(md5(key + struct.pack("<I", number)[:3] + b"\0\0")[: min(16, size + 5)], data)
    content = hidden(4, b"BT (Hidden words) Tj ET")
    parts = [
        b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/Count 1>>", b"<</Type/Page/Parent 2 0 R/Contents 4 0 R/Resources<<>>>>",
        b"<</Length %d>>stream\n%s\nendstream" % (len(content), content), b"<</Title <%s>>>" % hidden(5, b"Secret title").hex().encode(),
        b"<</Filter/Standard/V %d/R %d/Length %d/P -44/O<%s>/U<%s>>>" % (2 if revision > 2 else 1, revision, 8 * size, owner.hex().encode(), user.hex().encode()),
    ]
    return b"%PDF-1.4\n" + b"\n".join(b"%d 0 obj%s\nendobj" % (k + 1, p) for k, p in enumerate(parts)) + b"\ntrailer<</Root 1 0 R/Info 5 0 R/Encrypt 6 0 R/ID[<%s><00>]>>\n%%%%EOF" % one.hex().encode()
