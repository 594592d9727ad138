"""The exact engine over columns, in Arrow batches, behind the gate."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.redaction.engine import Redactor, Result
from docloom.operators.redaction.native import gate
from docloom.options import Level, RedactorOptions

RESULT = "struct<text:string,categories:array<string>,numbers:array<int>,spans:array<struct<start:int,length:int,category:string>>>"


def as_redactor(redactor: Redactor | RedactorOptions | Level | None) -> Redactor:
    return redactor if hasattr(redactor, "redact") else Redactor(redactor)


def _row(result: Result) -> dict:
    counts = result.counts
    spans = [{"start": s.start, "length": s.length, "category": s.category} for s in result.spans]
    return {"text": result.text, "categories": list(counts), "numbers": list(counts.values()), "spans": spans}


def _udf(redactor):
    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [_row(redactor.redact(t)) if t is not None else {"text": None, "categories": None, "numbers": None, "spans": None} for t in texts]
            yield pd.DataFrame(rows, columns=["text", "categories", "numbers", "spans"])

    return run


def _gated(text: Column, redactor) -> Column:
    if isinstance(redactor, Redactor):
        return F.when(gate(text, redactor.options), text)
    return text


def redacted(text: Column, redactor=None) -> Column:
    """struct of text, counts (map in order of appearance) and spans. Only texts that pass the gate go to Python."""
    redactor = as_redactor(redactor)
    r = _udf(redactor)(_gated(text, redactor))
    counts = F.map_from_arrays(F.coalesce(r["categories"], F.array().cast("array<string>")), F.coalesce(r["numbers"], F.array().cast("array<int>")))
    spans = F.coalesce(r["spans"], F.array().cast("array<struct<start:int,length:int,category:string>>"))
    return F.struct(F.coalesce(r["text"], text).alias("text"), counts.alias("counts"), spans.alias("spans"))


def redacted_text(text: Column, redactor=None) -> Column:
    redactor = as_redactor(redactor)
    return F.coalesce(_udf(redactor)(_gated(text, redactor))["text"], text)


def redact_column(df: DataFrame, column: str, redactor=None, *, into: str | None = None) -> DataFrame:
    """df with the column redacted and, if named, the whole result beside it. The engine runs once a row."""
    redactor = as_redactor(redactor)
    held = df.withColumn("_redacted", redacted(F.col(column), redactor))
    held = held.withColumn(column, F.col("_redacted.text"))
    return held.withColumnRenamed("_redacted", into) if into else held.drop("_redacted")


def register(spark: SparkSession, name: str = "redact", redactor=None) -> None:
    """Makes the engine a function of SQL: redact(text)."""
    redactor = as_redactor(redactor)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: redactor.redact(t).text if t is not None else None)

    spark.udf.register(name, run)


_RECORD_RESULT = "struct<text:string,values:array<string>,categories:array<string>,numbers:array<int>>"


def redact_records(records: DataFrame, redactor=None) -> DataFrame:
    """Records with text and metadata values redacted; counts of the text come first, then those of the values in order."""
    redactor = as_redactor(redactor)

    @F.pandas_udf(_RECORD_RESULT)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, lists in batches:
            rows = []
            for text, values in zip(texts, lists):
                counts: dict[str, int] = {}
                out = []
                for value in (text, *(values if values is not None else ())):
                    result = redactor.redact(value)
                    out.append(result.text)
                    for k, n in result.counts.items():
                        counts[k] = counts.get(k, 0) + n
                rows.append((out[0], out[1:], list(counts), list(counts.values())))
            yield pd.DataFrame(rows, columns=["text", "values", "categories", "numbers"])

    values = F.map_values("metadata")
    hit = F.lit(True)
    if isinstance(redactor, Redactor):
        hit = gate(F.col("text"), redactor.options) | F.exists(values, lambda v: gate(v, redactor.options))
    r = run(F.when(hit, F.col("text")), F.when(hit, values))
    held = records.withColumn("_r", r)
    changed = F.col("_r.categories").isNotNull() & (F.size("_r.categories") > 0)
    counts = F.when(changed, F.map_from_arrays("_r.categories", "_r.numbers")).otherwise(F.create_map().cast("map<string,int>"))
    return held.withColumns({
        "text": F.when(changed, F.col("_r.text")).otherwise(F.col("text")),
        "metadata": F.when(changed, F.map_from_arrays(F.map_keys("metadata"), F.col("_r.values"))).otherwise(F.col("metadata")),
        "redactions": counts,
    }).drop("_r")
