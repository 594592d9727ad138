"""Text steps that run inside the JVM: white space, clipping, HTML, entities and times."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(text: Column) -> Column:
    """All runs of white space, of any script, as one space; none at the ends. Null stays."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clipped(text: Column, limit: int) -> Column:
    """The first limit characters; 0 is no limit."""
    return F.substring(text, 1, limit) if limit > 0 else text


def is_clipped(text: Column, limit: int) -> Column:
    return F.coalesce(F.length(text) > limit, F.lit(False)) if limit > 0 else F.lit(False)


#: Entities replaced in the JVM; a text with any other goes to the full decoder.
COMMON = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\xa0", "copy": "\xa9", "reg": "\xae", "middot": "\xb7", "hellip": "…",
    "mdash": "—", "ndash": "–", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "\xab",
    "raquo": "\xbb", "bull": "•", "euro": "€", "amp": "&",
}


def _decoded(text: Column) -> Column:
    from docloom.sources.formats.base import unescaped

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else unescaped(t))

    return decode(text)


def entities_decoded(text: Column) -> Column:
    """Named and numbered entities, each once; unknown ones stay."""
    rare = text.rlike(r"&(?!(?:" + "|".join(COMMON) + r");)(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[0-9A-Za-z]+);")
    plain = text
    for entity, char in COMMON.items():  # amp is the last, so that no entity is made anew
        plain = F.replace(plain, F.lit(f"&{entity};"), F.lit(char))
    return F.when(rare, _decoded(F.when(rare, text))).otherwise(plain)


_HIDDEN = r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>"
_TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
_TAG = r"<[^>]+>"


def html_title(page: Column) -> Column:
    """Null if there is none or it is blank."""
    inner = F.regexp_replace(F.regexp_extract(page, _TITLE, 1), _TAG, " ")
    return F.nullif(normalized(entities_decoded(inner)), F.lit(""))


def html_text(page: Column) -> Column:
    """What a page says, without scripts, styles, comments and its title."""
    out = page
    for part in (_HIDDEN, r"(?s)<!--.*?-->", _TITLE, _TAG):
        out = F.regexp_replace(out, part, " ")
    return normalized(entities_decoded(out))


def html_block_text(page: Column) -> Column:
    """As html_text, but a line for each block and with the title."""
    out = F.regexp_replace(page, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ")
    out = F.regexp_replace(out, r"(?i)</?(?:p|div|h[1-6]|li|tr|br|blockquote|section)\b[^>]*>", "\n")
    out = entities_decoded(F.regexp_replace(out, _TAG, " "))
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t\f\x0b]+", " "), r" *\n *", "\n")
    return F.regexp_replace(F.regexp_replace(out, r"\n{2,}", "\n"), r"(?U)^\s+|\s+$", "")


def iso_utc(ts: Column) -> Column:
    """To the second, with Z; the session's time zone is UTC or the offset is taken off first."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_local(ts: Column, zone: str | None = None) -> Column:
    """With the offset of a zone (the session's if none is named)."""
    if zone is None:
        return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")
    shown = F.from_utc_timestamp(F.to_utc_timestamp(ts, F.current_timezone()), zone)
    minutes = ((F.unix_micros(shown) - F.unix_micros(F.to_utc_timestamp(ts, F.current_timezone()))) / 60_000_000).cast("int")
    offset = F.concat(F.when(minutes < 0, "-").otherwise("+"), F.lpad((F.abs(minutes) / 60).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad((F.abs(minutes) % 60).cast("string"), 2, "0"))
    return F.concat(F.date_format(shown, "yyyy-MM-dd'T'HH:mm:ss"), offset)
