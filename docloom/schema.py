"""Schemas of the tables that this package makes and reads."""

from __future__ import annotations

from pyspark.sql import types as T

RECORD = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("name", T.StringType()),
    T.StructField("extension", T.StringType()),
    T.StructField("folder", T.StringType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("modified", T.TimestampType()),
    T.StructField("type_bucket", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("text", T.StringType()),
    T.StructField("redactions", T.MapType(T.StringType(), T.IntegerType())),
    T.StructField("warnings", T.ArrayType(T.StringType())),
    T.StructField("content_hash", T.StringType()),
])
CHUNK = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("type_bucket", T.StringType()),
    T.StructField("index", T.IntegerType()),
    T.StructField("count", T.IntegerType()),
    T.StructField("start_offset", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])
MANIFEST = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("modified", T.TimestampType()),
    T.StructField("content_hash", T.StringType()),
])
