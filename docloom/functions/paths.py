"""Parts of paths and the buckets of file types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS: dict[str, str] = {
    f".{x}": bucket
    for bucket, names in {
        "Document": "pdf doc docx rtf odt epub",
        "Spreadsheet": "xlsx xls csv ods",
        "Presentation": "pptx ppt odp",
        "Text": "txt md log json xml html htm",
        "Email": "eml msg",
        "Image": "jpg jpeg png tiff tif heic webp gif bmp",
    }.items()
    for x in names.split()
}


def bucket_of(extension: str) -> str:
    return BUCKETS.get(extension.lower(), "Other")


def is_image(extension: str) -> bool:
    return bucket_of(extension) == "Image"


def type_bucket(extension: Column) -> Column:
    """The bucket of a lower-case extension with its dot."""
    out = F.lit("Other")
    by: dict[str, list[str]] = {}
    for ext, bucket in BUCKETS.items():
        by.setdefault(bucket, []).append(ext)
    chain = None
    for bucket, exts in by.items():
        hit = F.lower(extension).isin(*exts)
        chain = F.when(hit, bucket) if chain is None else chain.when(hit, bucket)
    return chain.otherwise(out)


def name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def extension(path: Column) -> Column:
    """From the last dot of the name on, in lower case; empty if the name has none or ends in it."""
    return F.lower(F.regexp_extract(name(path), r"(\.[^.]+)$", 1))


def folder(path: Column) -> Column:
    """The name of the folder right above; empty at the top."""
    return F.regexp_extract(path, r"([^/\\]*)[/\\][^/\\]*$", 1)


def without_scheme(path: Column) -> Column:
    return F.regexp_replace(path, r"^file:(//)?(?=/)", "")
