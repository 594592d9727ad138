"""Not-modified captures of a web archive, resolved to the full responses that they repeat.

A revisit record has no body. It is joined to the latest full response of the same
canonical URL that was captured before it (at the same time: with the smaller record id);
its validators (ETag, Last-Modified, payload digest) are compared with that response's,
and the permitted headers of a 304 answer are laid over the response's headers.

Defined results: a URL is made canonical by lower case of scheme and host, no ``www.``,
``m.`` or other leading part of MOBILE, no default port, fragment, user or tracking
parameters, parameters in order, and no ``index`` page or slash at the end; a null or
empty URL is a null key and matches nothing; validators that only one side has do not
count; a revisit whose validators contradict the response is ``validator-mismatch``, one
without any to compare is ``unvalidated``, without an earlier response ``no-response``,
otherwise ``resolved``; a null time is before all others; repeated rows are each
resolved. Header names are compared in lower case. An empty table gives no rows.

Data sizes: only keys, times, validators and headers of responses are moved, not bodies.
All records are split into ranges of about equal length by URL, time and record id, so that
a URL with a third of all rows, or many of one time or none, lies in many ranges; in a range the
latest response is found by a window, and each range's last response is handed on to later
ranges of its URL, one row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import scratch

#: Headers that a 304 answer may update (RFC 9110, section 15.4.5; RFC 9111, section 3.2).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary", "last-modified", "age")
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|session(id)?|sid)(=.*)?$"
MOBILE = r"^(www|m|mobile|amp)\."


def canonical(url: Column) -> Column:
    """The key under which captures of one page meet."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(rest, r"^([^/?]*)", 1), r"^[^@]*@", ""))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), MOBILE, "")
    path = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, r"/index\.[A-Za-z]+$", "/"), r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    whole = F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))
    return F.when(F.length(host) > 0, whole)


def _lower(headers: Column) -> Column:
    """Names in lower case, the last of equal names."""
    pairs = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value")))
    last = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(e["value"]))))
    return F.coalesce(last, F.create_map().cast("map<string,string>"))


def merged(response: Column, revisit: Column) -> Column:
    """The response's headers under the revisit's permitted ones."""
    new = F.map_filter(_lower(revisit), lambda k, _: k.isin(*PERMITTED))
    old = F.map_filter(_lower(response), lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return F.map_concat(old, new)


def _etag(value: Column) -> Column:
    return F.regexp_replace(F.trim(value), "^W/", "")


def resolved(records: DataFrame, *, slices: int | None = None) -> DataFrame:
    """slices: how many ranges (None: as many as shuffle partitions). One row a revisit: record_id, url_key, response_id, status, checked (the validators that were compared) and headers.

    records: record_id, url, ts, kind ('response' or 'revisit'), status, etag,
    last_modified, digest and headers (map<string,string>); a full response has status 200.
    """
    slices = slices or scratch.partitions(records.sparkSession)
    rows = records.select(
        "record_id", canonical(F.col("url")).alias("url_key"), "ts", "kind", "status", _etag(F.col("etag")).alias("etag"),
        F.trim("last_modified").alias("last_modified"), F.lower(F.trim("digest")).alias("digest"), "headers",
    ).where("kind = 'revisit' or (kind = 'response' and status = 200)")
    rows = scratch.written(rows, "warc-records")
    # Rows repeated as a whole may be in several ranges, by their place in the written table.
    rows = rows.withColumn("nth", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(slices, F.col("url_key").asc_nulls_first(), F.col("ts").asc_nulls_first(), F.col("record_id").asc_nulls_first(), F.col("kind"), F.col("nth"))
    rows = scratch.written(rows.withColumn("slice", F.spark_partition_id()).drop("nth"), "warc-ranges")
    held = F.struct("record_id", "etag", "last_modified", "digest", "headers")
    rows = rows.withColumn("response", F.when(F.col("kind") == "response", held))
    keyed = rows.where("url_key is not null")
    order = [F.col("ts").asc_nulls_first(), F.col("record_id").asc_nulls_first(), F.col("kind")]
    inner = Window.partitionBy("url_key", "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = keyed.withColumn("near", F.last("response", ignorenulls=True).over(inner)).where("kind = 'revisit'")
    ends = keyed.where("kind = 'response'").groupBy("url_key", "slice").agg(
        F.max_by("response", F.struct(F.coalesce(F.col("ts").cast("double"), F.lit(float("-inf"))), F.col("record_id"))).alias("end")
    )
    wanted = seen.where("near is null").select("url_key", "slice").distinct()
    both = ends.unionByName(wanted, allowMissingColumns=True).groupBy("url_key", "slice").agg(F.first("end", ignorenulls=True).alias("end"))
    earlier = Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # a row a slice
    carried = both.withColumn("carried", F.last("end", ignorenulls=True).over(earlier)).where("carried is not null").select("url_key", "slice", "carried")
    met = seen.join(carried, ["url_key", "slice"], "left").withColumn("found", F.coalesce("near", "carried"))
    lost = rows.where("kind = 'revisit' and url_key is null").withColumn("found", F.lit(None).cast(met.schema["found"].dataType))
    names = ["record_id", "url_key", "etag", "last_modified", "digest", "headers", "found"]
    met = met.select(*names).unionByName(lost.select(*names))
    checks = ("etag", "last_modified", "digest")
    own = {c: (F.coalesce(F.col(c), F.lit("")) != "") & (F.coalesce(F.col(f"found.{c}"), F.lit("")) != "") for c in checks}
    checked = F.array_compact(F.array(*[F.when(own[c], F.lit(c)) for c in checks]))
    wrong = F.lit(False)
    for c in checks:
        wrong = wrong | F.coalesce(own[c] & (F.col(c) != F.col(f"found.{c}")), F.lit(False))
    status = F.when(F.col("found").isNull(), "no-response").when(wrong, "validator-mismatch").when(F.size(checked) == 0, "unvalidated").otherwise("resolved")
    out = met.withColumn("checked", F.when(F.col("found").isNull(), F.array().cast("array<string>")).otherwise(checked)).withColumn("status", status)
    return out.select(
        "record_id", "url_key", F.when(F.col("status") != "no-response", F.col("found.record_id")).alias("response_id"), "status", "checked",
        F.when(F.col("status") == "resolved", merged(F.col("found.headers"), F.col("headers"))).otherwise(_lower(F.col("headers"))).alias("headers"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Records made of a table of pages (page_id, url, html), as of a crawl that comes by some addresses often.

    Page p is fetched at second 10 p (every eleventh time the answer is a 404) and asked for
    again at second 10 p + 5. Besides, each page sees a fetch of an address that many pages
    share, the front page of its domain or a section of its host, at second 10 (p - p % 4): every fifth
    one is a full response, the others are revisits. The shared address has a new ETag every
    97 pages, a new Last-Modified every 61 and a new body every 41, so that clients' validators
    may be older or newer than the latest response; some have none, some an ETag of before.
    """
    p = F.col("page_id")
    text = p.cast("string")
    digest = F.concat(F.lit("sha1:"), F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    base = pages.select("page_id", "url", F.coalesce(text, F.lit("null")).alias("n"), digest.alias("digest"), canonical(F.col("url")).alias("key"))
    base = base.withColumn("host", F.regexp_extract("key", "^[^/?]*", 0)).withColumn("section", F.regexp_extract("key", "^[^/?]*/([^/?]*)", 1))
    base = base.withColumn("topic", F.when(p % 2 == 0, F.regexp_extract("host", r"[^.]+\.[^.]+$", 0)).otherwise(F.concat("host", F.lit("/"), "section")))
    shared = F.when(p % 2 == 0, F.concat(F.lit("HTTP://www."), "topic", F.lit(":80/index.html?utm_source="), text)).otherwise(F.concat(F.lit("https://m."), "topic", F.lit("/#n"), text))
    of = lambda every, less=0: F.concat("topic", F.lit(":"), (F.floor(p / every) - less).cast("string")).cast("binary")
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    etag = lambda less=0: quoted(F.substring(F.md5(of(97, less)), 1, 12))
    modified, body = F.concat(F.lit("day "), F.floor(p / 61).cast("string")), F.concat(F.lit("sha1:"), F.sha1(of(41)))
    own = quoted(F.substring("digest", 6, 12))
    none = F.lit(None).cast("string")

    def record(rows: DataFrame, name: str, url: Column, ts: Column, full: Column, status: Column, etag: Column, last_modified: Column, digest: Column) -> DataFrame:
        date = F.concat(F.lit("t"), ts.cast("string"))
        answer = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), etag, F.lit("Date"), date, F.lit("X-Page"), F.col("n"))
        short = F.create_map(F.lit("Date"), date, F.lit("Server"), F.lit("cache"), F.lit("Cache-Control"), F.lit("max-age=60"))
        return rows.select(
            F.concat("n", F.lit(name)).alias("record_id"), url.alias("url"), ts.alias("ts"), F.when(full, "response").otherwise("revisit").alias("kind"),
            F.when(full, status).otherwise(304).cast("int").alias("status"), etag.alias("etag"), last_modified.alias("last_modified"), digest.alias("digest"),
            F.when(full, answer).otherwise(short).alias("headers"),
        )

    fetched = record(base, "-page", F.col("url"), p * 10, F.lit(True), F.when(p % 11 == 5, 404).otherwise(200), own, none, F.col("digest"))
    asked = record(base, "-again", F.when(p % 13 != 6, F.col("url")), p * 10 + 5, F.lit(False), F.lit(304), F.concat(F.lit("W/"), own), none, F.when(p % 4 < 2, F.col("digest")))
    full, k = p % 5 == 0, p % 7
    met = record(
        base, "-shared", shared, (p - p % 4) * 10, full, F.lit(200),
        F.when(full, etag()).when(k.isin(1, 2, 6), F.concat(F.lit("W/"), etag())).when(k == 3, etag(1)), F.when(full | (k == 4), modified), F.when(full, body).when(k.isin(5, 6), F.upper(body)),
    )
    return fetched.unionByName(asked).unionByName(met)
