import pytest
from pyspark.sql import functions as F

from docloom.functions import paths, text
from docloom.operators.chunking import chunked
from docloom.options import ChunkOptions
from docloom.sources.formats.base import unescaped


def test_white_space_and_clip(spark):
    rows = spark.createDataFrame([("  a\u00a0\u2003b\r\n\tc\x85 ",), ("",), (None,), (" \n ",)], "t string")
    assert [r[0] for r in rows.select(text.normalized(F.col("t"))).collect()] == ["a b c", "", None, ""]
    r = spark.createDataFrame([("abcdef",)], "t string").select(text.clipped(F.col("t"), 3), text.clipped(F.col("t"), 0), text.is_clipped(F.col("t"), 3), text.is_clipped(F.col("t"), 6)).first()
    assert tuple(r) == ("abc", "abcdef", True, False)


@pytest.mark.parametrize("page, title, body", [
    ("<html><title>A &amp; B</title><body><p>Hi <b>you</b></p></body></html>", "A & B", "Hi you"),
    ("<script>var t='</p>'</script><STYLE a=b>x</STYLE >text<!-- no\n -->more", None, "text more"),
    ("&lt;tag&gt; &amp;lt; &#233;&#xe9; &eacute; &bogus; &amp &copy;", None, "<tag> &lt; éé é &bogus; &amp ©"),
    ("<title> </title>x", None, "x"), ("<TITLE>one</TITLE><title>two</title>", "one", ""), ("", None, ""),
])
def test_html(spark, page, title, body):
    from docloom.sources.formats import Html

    r = spark.createDataFrame([(page,)], "h string").select(text.html_title(F.col("h")).alias("t"), text.html_text(F.col("h")).alias("b")).first()
    assert (r.t, r.b) == (title, body)
    found = Html().extract("x.html", page.encode())
    assert found.text == body and found.metadata.get("Title") == title


def test_entities_are_decoded_once():
    assert unescaped("&amp;lt; &#38;lt; &#xZ; &#0; &#1114112; &nbsp;") == "&lt; &lt; &#xZ; &#0; &#1114112; \xa0"


def test_paths(spark):
    rows = [("/a/b/Report.PDF", "Report.PDF", ".pdf", "b", "Document"), ("x.tar.gz", "x.tar.gz", ".gz", "", "Other"), ("/a/none", "none", "", "a", "Other"), ("d/.hidden", ".hidden", ".hidden", "d", "Other"), ("/p/i.JPeG", "i.JPeG", ".jpeg", "p", "Image")]
    p = F.col("p")
    out = spark.createDataFrame([(r[0],) for r in rows], "p string").select(p, paths.name(p), paths.extension(p), paths.folder(p), paths.type_bucket(paths.extension(p))).collect()
    assert [tuple(r) for r in out] == rows
    assert paths.bucket_of(".EML") == "Email" and paths.is_image(".png") and not paths.is_image(".pdf")


def test_times(spark):
    r = spark.sql("select timestamp'2026-07-19 10:00:00.987' as t").select(text.iso_utc(F.col("t")), text.iso_local(F.col("t"), "Asia/Kolkata"), text.iso_local(F.col("t"), "America/New_York")).first()
    assert tuple(r) == ("2026-07-19T10:00:00Z", "2026-07-19T15:30:00+05:30", "2026-07-19T06:00:00-04:00")


def plain_chunks(t, o):
    out, start = [], 0
    while start < len(t):
        end = min(len(t), start + o.max_chars)
        cut = end
        if end < len(t) and o.respect_word_boundaries:
            for k in range(end - 1, start, -1):
                if t[k].isspace():
                    cut = k + 1 if k + 1 >= start + o.step else end
                    break
        out.append((start, t[start:cut]))
        if end == len(t):
            break
        start += o.step
    return out


@pytest.mark.parametrize("options", [ChunkOptions(), ChunkOptions(respect_word_boundaries=False), ChunkOptions(50, 20), ChunkOptions(10, 0), ChunkOptions(1, 0)])
def test_chunks(spark, options):
    texts = ["", "x" * 2500, "lorem " * 400, "a\u2003b c" * 40, "short", "y" * 900, "y" * 1000, "y" * 1001, "z z" * 700]
    df = spark.createDataFrame(list(enumerate(texts)), "path int, text string")
    out = chunked(df, options).orderBy("path", "index").collect()
    want = [(k, n, len(c), s, p) for k, t in enumerate(texts) for c in [plain_chunks(t, options)] for n, (s, p) in enumerate(c)]
    assert [(r.path, r["index"], r["count"], r.start_offset, r.text) for r in out] == want


def test_chunk_options():
    for bad in ((0, 0), (10, 10), (10, -1)):
        with pytest.raises(ValueError):
            ChunkOptions(*bad)
