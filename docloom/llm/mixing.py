"""Mixing sources to target weights by capped water-filling.

Each source gets a share of a budget in proportion to its weight, but no more than a
maximum number of epochs of its own size; what is over goes to the other sources by
weight, until no source is above its limit. A source's target then becomes whole
repetitions of all its documents and one more, seeded, of a part of them.

Defined results: a null text has size 0, as has one without words; a null source is a
source of its own; a source without a weight, or of size 0, has target 0; a null doc_id
is drawn like any other; rows that share a doc_id are drawn together; if the budget is
more than all limits allow, each source gets its limit. An empty table gives no rows.
Other columns of the input are ignored (``mixed``: kept), whatever their names.

Data sizes: the text is read once, for a table of one narrow row a document; per source
there is one row and a partial sum for about BIN_ROWS documents (4096 at least), so a source
with a third of all rows is added up where its rows are, and only one such part of it is put
in order by one task. A very long text counts as any other. The driver sees three numbers a
round and a row for each partition of the sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Documents are put in the order of leading bits of a hash before they are ordered exactly: of so many bits at least, and of as many more as leave about BIN_ROWS documents of a source for the exact order.
BIN_BITS, BIN_ROWS = 12, 1 << 16


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def draw(doc_id: Column, seed: int) -> Column:
    """A uniform integer below 2**60 that depends on the seed and the id alone."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame, seed: int, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, source, size, u: one narrow row a document, written once."""
    return scratch.written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            n_words(F.col(text_col)).alias("size"),
            draw(F.col(id_col), seed).alias("u"),
        ),
        "mix-sizes",
    )


def ranked(df: DataFrame, order: Column) -> DataFrame:
    """df with rank: each row's position from 0 in the global order, found without one task seeing all rows."""
    spark = df.sparkSession
    parts = scratch.written(
        df.repartitionByRange(scratch.partitions(spark), order)
        .sortWithinPartitions(order)
        .select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")),
        "ranked",
    )
    before, base = 0, {}
    for part, n in sorted(parts.groupBy("_part").count().collect()):  # at most a row for each partition
        base[part], before = before, before + n
    if not base:
        return parts.select(*df.columns, F.lit(0).cast("long").alias("rank"))
    known = F.broadcast(spark.createDataFrame(list(base.items()), "_part int, _base long"))  # a row for each partition
    return parts.join(known, "_part").select(*df.columns, (F.col("_at") + F.col("_base")).cast("long").alias("rank"))


def fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """sources (source, size, weight) with target: water-filling under limits of max_epochs times the size."""
    limit, weight = F.col("size") * F.lit(float(max_epochs)), F.coalesce(F.col("weight"), F.lit(0)).cast("double")
    level: float | None = None
    while True:
        over = F.lit(False) if level is None else (weight * F.lit(level) > limit)
        held, free = sources.agg(
            F.coalesce(F.sum(F.when(over, limit)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, weight)), F.lit(0.0))
        ).first()
        if free <= 0:
            level = float("inf")
            break
        new = (budget - held) / free
        if level is not None and new <= level:
            break
        level = new
    wanted = F.when(weight > 0, limit) if level == float("inf") else F.least(weight * F.lit(level), limit)
    return sources.withColumn("target", F.coalesce(wanted, F.lit(0.0)))


def joined(docs: DataFrame, sources: DataFrame, on: str = "source") -> DataFrame:
    """docs with the columns of their source; sources has one row each. As it is a written table, its size is known, and Spark broadcasts it below its own threshold; beyond, adaptive execution splits a hot source."""
    right = sources.withColumnRenamed(on, "_source")
    return docs.join(right, docs[on].eqNullSafe(F.col("_source")), "left").drop("_source")


def plan(sizes: DataFrame, weights: DataFrame, *, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """One row a source: source, size, weight, target, whole (repetitions of all documents) and last.

    A document is taken once more if its u is at most last (-1: none). Documents of a
    source are in the order of u, and the last one taken is that whose middle lies
    before the end of the part that is wanted, so the sum misses the target by half a
    document at most.
    """
    bits = max(BIN_BITS, (sizes.count() // BIN_ROWS).bit_length())
    shift = 60 - bits
    bins = scratch.written(
        sizes.groupBy("source", F.shiftright("u", shift).alias("bin")).agg(F.sum("size").alias("size")), "mix-bins"
    )
    totals = bins.groupBy("source").agg(F.sum("size").alias("size"))
    right = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("weight"))
    totals = totals.join(right, totals["source"].eqNullSafe(right["_s"]), "left").drop("_s")
    totals = scratch.written(totals, "mix-totals")
    budget = share * (totals.agg(F.sum("size")).first()[0] or 0)
    filled = fill(totals, budget, max_epochs)
    filled = filled.withColumn("whole", F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(F.lit(0)).cast("long"))
    filled = scratch.written(filled.withColumn("part", F.col("target") - F.col("whole") * F.col("size")), "mix-plan")
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most 2**bits rows a source
    edge = joined(bins.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))), filled.select("source", "part"))
    edge = edge.where("part > 0 and before < part").groupBy("source").agg(
        F.max("bin").alias("edge"), F.max_by("before", "bin").alias("before"), F.max("part").alias("part")
    )
    edge = scratch.written(edge, "mix-edge")
    inside = joined(sizes.select("source", "size", "u"), edge).where(F.shiftright("u", shift) == F.col("edge"))
    upto = Window.partitionBy("source").orderBy("u").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(upto), F.lit(0)))
    last = scratch.written(inside.where(F.col("at") + F.col("size") / 2 <= F.col("part")).groupBy("source").agg(F.max("u").alias("last")), "mix-found")
    low = edge.select("source", (F.shiftleft("edge", shift) - 1).alias("low"))
    cut = joined(joined(filled, low), last.withColumnRenamed("last", "found"))
    return cut.select(
        "source", "size", "weight", "target", "whole", F.coalesce("found", "low", F.lit(-1).cast("long")).alias("last")
    )


def copies(u: Column) -> Column:
    """How often a document is in the mix, beside the columns of its source's plan."""
    return F.coalesce(F.col("whole") + F.when(u <= F.col("last"), 1).otherwise(0), F.lit(0)).cast("long")


def taken(docs: DataFrame, weights: DataFrame | None = None, *, share: float = 1.5, max_epochs: float = 2.0, seed: int = 1) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each document; weights: source, weight (None: ``cycled``)."""
    sizes = sized(docs, seed)
    weights = cycled(sizes) if weights is None else weights
    per = scratch.written(plan(sizes, weights, share=share, max_epochs=max_epochs), "mix-last")
    per = per.select("source", F.col("size").alias("source_size"), "target", "whole", "last")
    out = joined(sizes, per).withColumn("copies", copies(F.col("u")))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def cycled(sizes: DataFrame, cycle: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """source, weight: the sources in code point order, null last, weigh 5, 2, 1, 5, 2, 1 and so on."""
    order = ranked(sizes.select("source").distinct(), F.col("source").asc_nulls_last())
    at = F.pmod(F.col("rank"), F.lit(len(cycle))).cast("int") + 1
    return order.select("source", F.element_at(F.array(*[F.lit(float(x)) for x in cycle]), at).alias("weight"))


def mixed(docs: DataFrame, weights: DataFrame | None = None, *, share: float = 1.5, max_epochs: float = 2.0, seed: int = 1) -> DataFrame:
    """The rows of docs, all columns as they are, each as often as the mix takes it."""
    sizes = sized(docs, seed)
    weights = cycled(sizes) if weights is None else weights
    per = scratch.written(plan(sizes, weights, share=share, max_epochs=max_epochs), "mix-last")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").alias("source"), draw(F.col("doc_id"), seed).alias("u"))
    out = joined(held, per.select("source", "whole", "last")).withColumn("copies", copies(F.col("u")).cast("int"))
    return out.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select("row.*")
