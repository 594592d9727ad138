import pytest
from pyspark.sql import functions as F

from docloom.llm import revisits

SCHEMA = "record_id string, url string, ts long, kind string, status int, etag string, last_modified string, digest string, headers map<string,string>, slice int, found string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA)


def record(i, url, ts, kind="response", status=200, etag=None, modified=None, digest=None, headers=None):
    return (i, url, ts, kind, status if kind == "response" else 304, etag, modified, digest, headers)


@pytest.mark.parametrize("a, b", [
    ("http://www.Example.com/x", "https://example.com:443/x/"), ("http://e.org/a?b=1&a=2", "http://e.org/a?a=2&b=1&utm_source=q&ref=z#top"),
    ("http://m.e.org/", "http://u:p@e.org/index.html"), ("http://e.org", "http://e.org/?sid=4"),
])
def test_urls_that_are_one(spark, a, b):
    r = spark.createDataFrame([(a, b)], "a string, b string").select(revisits.canonical(F.col("a")), revisits.canonical(F.col("b"))).first()
    assert r[0] == r[1] and r[0]


def test_urls_that_are_none_or_differ(spark):
    rows = spark.createDataFrame([("http://e.org/A",), ("http://e.org/a",), ("http://e.org/a?x=1",), ("",), (None,), ("http://",)], "u string").select(revisits.canonical(F.col("u"))).collect()
    assert len({r[0] for r in rows}) == 4 and [r[0] for r in rows[3:]] == [None] * 3


def plain(rows, keys):
    out = []
    for r in rows:
        if r[3] != "revisit":
            continue
        stamp = lambda x: (x[2] is not None, x[2] or 0, x[0])
        earlier = [x for x in rows if x[3] == "response" and x[4] == 200 and keys[x[1]] is not None and keys[x[1]] == keys[r[1]] and stamp(x) <= stamp(r)]
        best = max(earlier, key=stamp, default=None)
        if best is None:
            out.append((r[0], None, "no-response"))
            continue
        weak = lambda e: (e or "").strip().removeprefix("W/")
        pairs = [(weak(r[5]), weak(best[5])), ((r[6] or "").strip(), (best[6] or "").strip()), ((r[7] or "").lower(), (best[7] or "").lower())]
        pairs = [(a, b) for a, b in pairs if a and b]
        out.append((r[0], best[0], "validator-mismatch" if any(a != b for a, b in pairs) else "resolved" if pairs else "unvalidated"))
    return sorted(out, key=repr)


def awkward():
    rows = [record(f"r{k:03d}", "http://hot.org/p", 10 * k, etag=f'"{k // 3}"', headers={"ETag": f"{k}", "X": "y"}) for k in range(60)]
    rows += [record(f"v{k:03d}", "https://www.hot.org/p/", 7 * k, "revisit", etag=f'W/"{7 * k // 30}"', headers={"Date": "d"}) for k in range(80)]
    rows += [record("a", "http://one.org/", None, headers=None), record("b", "http://one.org/", None, "revisit"), record("c", None, 5, "revisit", etag="x"), record("d", None, 1, etag="x")]
    rows += [record("e", "http://two.org/", 5, status=404), record("f", "http://two.org/", 9, "revisit"), record("g", "http://two.org/", 9, digest="SHA1:A"), record("h", "http://two.org/", 9, "revisit", digest="sha1:a")]
    rows += [record("k", "http://tie.org/", 4, "revisit", modified="m"), record("j", "http://tie.org/", 4, modified="m"), record("l", "http://tie.org/", 4, modified="n")]
    return rows + rows[60:63]


@pytest.mark.parametrize("slices", [1, 5])
def test_equals_brute_force(spark, slices):
    rows = awkward()
    df = table(spark, rows)
    keys = {r[0]: r[1] for r in df.select("url", revisits.canonical(F.col("url"))).distinct().collect()}
    out = revisits.resolved(df, slices=slices).select("record_id", "response_id", "status").collect()
    assert sorted(map(tuple, out), key=repr) == plain(rows, keys)


def test_headers(spark):
    rows = [
        record("r", "http://e.org/", 1, etag='"1"', headers={"ETag": '"1"', "Content-Type": "text/html", "Date": "old", "Cache-Control": "x"}),
        record("v", "http://e.org/", 2, "revisit", etag='"1"', headers={"DATE": "new", "Content-Type": "bad", "Set-Cookie": "bad", "Expires": "e"}),
        record("w", "http://e.org/", 3, "revisit", etag='"2"', headers={"Date": "own"}),
    ]
    out = {r.record_id: r for r in revisits.resolved(table(spark, rows)).collect()}
    assert out["v"].headers == {"etag": '"1"', "content-type": "text/html", "date": "new", "cache-control": "x", "expires": "e"} and out["v"].checked == ["etag"]
    assert out["w"].headers == {"date": "own"} and out["w"].status == "validator-mismatch"


def test_empty_table(spark):
    assert revisits.resolved(table(spark, [])).count() == 0
    assert revisits.resolved(table(spark, [record("a", "http://e.org/", 1)])).count() == 0


def test_the_query_needs_the_join(spark):
    """Over the given pages all statuses come up, and most revisits are resolved to another page's response."""
    from docloom.llm.queries import op6_warc_revisits

    rows = op6_warc_revisits(spark, "/root/testdata/sf0.01").collect()
    assert {r.status for r in rows} == {"resolved", "validator-mismatch", "unvalidated", "no-response"} and any(r.url_key is None for r in rows)
    page = lambda name: name.split("-")[0]
    assert sum(r.response_id is not None and page(r.response_id) != page(r.record_id) for r in rows) > 50
    assert {c for r in rows for c in r.checked.split(",")} == {"", "etag", "last_modified", "digest"}


def test_captures_of_awkward_pages(spark):
    pages = spark.createDataFrame([(None, None, None, "x"), (0, "", "", "y"), (1, "http://", None, "z"), (5, "http://e.org/en/a?x=1", "h", "w"), (5, "http://e.org/en/a?x=1", "h", "w")], "page_id long, url string, html string, slice string")
    out = revisits.resolved(revisits.captures(pages)).collect()
    assert sorted(r.record_id for r in out if r.record_id.endswith("-again")) == ["0-again", "1-again", "5-again", "5-again", "null-again"]
    assert all(r.status == "no-response" for r in out if r.url_key is None) and sum(r.url_key is None for r in out) >= 3


def test_one_url_lies_in_many_ranges(spark):
    """Rows of one URL, of one time, without a time, and repeated as a whole."""
    rows = [record(f"r{k:03d}", "http://e.org/", None if k % 2 else 5, "revisit" if k % 3 else "response", etag=str(k % 4)) for k in range(200)] + [record("v", "http://e.org/", 5, "revisit", etag="x")] * 100
    df = table(spark, rows)
    out = revisits.resolved(df, slices=9).select("record_id", "response_id", "status").collect()
    assert sorted(map(tuple, out), key=repr) == plain(rows, {"http://e.org/": "e.org"})
