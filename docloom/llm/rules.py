"""Quality rules whose cutoffs are chosen under a bound on false rejection.

Each rule has cutoffs from a loose to a strict one in STEPS equal steps, fixed beforehand.
One path takes all rules together from loose to strict: at step s every rule has its s-th
cutoff, and a document's step is the first at which some rule rejects it. For each stratum
(language) the path is followed as long as the exact binomial (Clopper-Pearson) upper bound
of the share of good documents that are rejected stays within the allowed share. These
tests are a fixed sequence that ends at the first failure, so the level is divided by the
number of strata alone (Bonferroni): with level 0.05 and four strata, all cutoffs chosen
keep the allowed share with probability 0.95, and 217 good labels of which none is
rejected are enough for a first step. Of the steps that pass, that is taken which rejects
the most bad labels, a good one weighing as much as GOOD_WEIGHT bad ones. A stratum with
too few labels for any step has no cutoffs, and its documents stay.

Defined results: a null or empty text has no words and fails the base rules; a very long
text is measured whole; a null stratum is a stratum; a document whose labels contradict
each other is not used for the cutoffs; a null label is none; repeated rows get equal
results and an empty table none. With no labels at all, the base rules alone decide. Other
columns are ignored.

Data sizes: texts are read once for one narrow row a document; labels meet these rows in a
join by id, are counted by stratum and step, and the cutoffs of a stratum come from at most
STEPS + 1 counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import mixing, scratch, tokens, wordvec
from docloom.llm.lines import SPACE

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
#: The allowed share of good documents rejected by all rules together, and the level of all bounds together.
ALLOWED, LEVEL = 0.02, 0.05
GOOD_WEIGHT = 25
STEPS = 64

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_BANG = np.zeros(256, bool)
_BANG[33] = True
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_bangs long"


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeat_words(w: wordvec.Words, n: int = WINDOW) -> np.ndarray:
    """For each row, how many words lie in an n-word window that the row has twice or more."""
    h = wordvec.word_hashes(w)
    values, at = wordvec.windows(h, w.row, n)
    keyed = values ^ wordvec.mix(w.row[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keyed, kind="stable")
    same = keyed[order][1:] == keyed[order][:-1]
    twice = np.zeros(len(at) + 1, bool)
    twice[:-1][order[1:][same]] = True
    twice[:-1][order[:-1][same]] = True
    begins = at[twice[:-1]]
    change = np.zeros(len(h) + 1, np.int64)
    np.add.at(change, begins, 1)
    np.add.at(change, begins + n, -1)
    covered = np.cumsum(change)[: len(h)] > 0
    return _per_row(covered, w.first)


def stats_of(column: pa.Array) -> list[np.ndarray]:
    """The columns of STATS for a column of texts."""
    data, offsets = wordvec.buffers(column)
    out: list[list[np.ndarray]] = []
    for a, b in wordvec.runs(offsets):
        own, cut = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        w = wordvec.words(own, cut)
        inside = ~wordvec._SPACE[own]
        out.append([np.diff(w.first), _per_row(inside & ((own & 0xC0) != 0x80), cut), _per_row(_SYMBOL[own], cut), repeat_words(w), _per_row(_UPPER[own], cut), _per_row(_BANG[own], cut)])
    n_words, chars, symbols, repeats, upper, bangs = (np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in range(6))
    n_dup, n_lines = [], []
    for text in tokens.each(column):
        lines = text.split(b"\n")
        full = [line for line in lines if line.strip(SPACE)]
        n_lines.append(len(full))
        n_dup.append(len(full) - len(set(full)))
    return [n_words, chars, symbols, np.array(n_dup, np.int64), repeats, np.array(n_lines, np.int64), upper, bangs]


def measured(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, stratum and the columns of STATS of each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [x.split()[0] for x in STATS.split(", ")]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [pa.array(x, pa.int64()) for x in stats_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "stratum", *names])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{stratum_col}`").cast("string").alias("stratum"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(measure, f"doc_id {kind}, stratum string, {STATS}")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))


def _rate(top: str, below: str) -> Column:
    return F.coalesce(F.col(top) / F.when(F.col(below) > 0, F.col(below)), F.lit(0.0))


def rules() -> dict[str, tuple[Column, float, float]]:
    """Name: the value, and the loosest and the strictest cutoff. A value above a cutoff is rejected."""
    mean = _rate("word_chars", "n_words")
    return {
        "symbols": (_rate("n_symbols", "n_words"), 1.0, 0.02),
        "dup_lines": (_rate("n_dup_lines", "n_lines"), 1.0, 0.15),
        "repeats": (_rate("n_repeat_words", "n_words"), 0.3, 0.1),
        "upper": (_rate("n_upper", "word_chars"), 1.0, 0.05),
        "bangs": (_rate("n_bangs", "n_words"), 1.0, 0.02),
        "long_words": (mean, 40.0, 6.0),
        "short_words": (F.lit(8.0) - mean, 8.0, 4.0),
    }


def width(loose: float, strict: float) -> float:
    """Between two steps of a rule's cutoffs; step 0 is the loosest, step STEPS - 1 the strictest."""
    return (loose - strict) / (STEPS - 1)


def _step(value: Column, loose: float, strict: float) -> Column:
    """The first step whose cutoff is below the value; STEPS if none is."""
    first = F.floor((F.lit(loose) - value) / F.lit(width(loose, strict))) + F.when(value > F.lit(loose), 0).otherwise(1)
    return F.least(F.lit(STEPS), F.greatest(F.lit(0), first)).cast("int")


def stepped(stats: DataFrame) -> DataFrame:
    """stats with step (the first that rejects the document) and steps (of each rule)."""
    each = [_step(*rule).alias(name) for name, rule in rules().items()]
    return stats.withColumn("steps", F.struct(*each)).withColumn("step", F.least(*[F.col(f"steps.{name}") for name in rules()]))


def binomial_below(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial variable."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def within(k: int, n: int, share: float, level: float) -> bool:
    """Whether the exact upper bound of a share, of which k of n were seen, is at most share at the level."""
    return n > 0 and k < n * share and binomial_below(k, n, share) <= level


def chosen(good: np.ndarray, bad: np.ndarray, share: float, level: float) -> int | None:
    """The step to cut at. good, bad: labels by step, where step s is of values between cutoffs s - 1 and s, from 0 (loosest cutoff passed) on."""
    n, best, found = int(good.sum()), 0, None
    rejected_good = rejected_bad = 0
    for step in range(len(good) - 1):  # the last step holds values that no cutoff rejects
        rejected_good, rejected_bad = rejected_good + int(good[step]), rejected_bad + int(bad[step])
        if not within(rejected_good, n, share, level):
            break
        value = rejected_bad - GOOD_WEIGHT * rejected_good
        if value > best:
            best, found = value, step
    return found


def cutoffs(stats: DataFrame, labels: DataFrame, *, allowed: float = ALLOWED, level: float = LEVEL, label_col: str = "quality") -> DataFrame:
    """stratum, cut (the chosen step, null where none is sure) and one column a rule: its cutoff there."""
    table = rules()
    right = labels.select(F.col("doc_id").alias("_id"), F.col(label_col).alias("label")).where("label is not null and _id is not null")
    right = right.groupBy("_id").agg(F.min("label").alias("label"), F.max("label").alias("_top")).where("label = _top")
    held = stepped(stats.where(~base_failed())).join(right, F.col("doc_id") == F.col("_id"))
    counts = held.groupBy("stratum", "step").agg(F.count_if(F.col("label") > 0).alias("good"), F.count_if(F.col("label") <= 0).alias("bad"))
    counts = scratch.written(counts, "rules-counts")
    tests = max(1, counts.select("stratum").distinct().count())
    edges = {name: (loose, width(loose, strict)) for name, (_, loose, strict) in table.items()}

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        good, bad = np.zeros(STEPS + 1, np.int64), np.zeros(STEPS + 1, np.int64)
        np.add.at(good, rows["step"].to_numpy(), rows["good"].to_numpy())
        np.add.at(bad, rows["step"].to_numpy(), rows["bad"].to_numpy())
        step = chosen(good, bad, allowed, level / tests)
        out = {"stratum": [rows["stratum"].iloc[0]], "cut": pd.array([step], "Int32")}
        out |= {name: [None if step is None else loose - step * by] for name, (loose, by) in edges.items()}
        return pd.DataFrame(out).astype({name: "float64" for name in edges})

    schema = "stratum string, cut int, " + ", ".join(f"{name} double" for name in table)
    return scratch.written(counts.groupBy("stratum").applyInPandas(choose, schema), "rules-cutoffs")


def judged(docs: DataFrame, labels: DataFrame, *, allowed: float = ALLOWED, level: float = LEVEL, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, stratum, the columns of STATS, base_failed, failed (the rules that a document fails) and kept."""
    stats = scratch.written(measured(docs, id_col=id_col, text_col=text_col, stratum_col=stratum_col), "rules-stats")
    sure = cutoffs(stats, labels, allowed=allowed, level=level)
    met = mixing.joined(stepped(stats), sure.select("stratum", "cut"), "stratum")
    failed = F.array_compact(F.array(*[F.when(F.col(f"steps.{name}") <= F.col("cut"), F.lit(name)) for name in rules()]))
    met = met.withColumn("base_failed", base_failed()).withColumn("failed", failed)
    names = [x.split()[0] for x in STATS.split(", ")]
    return met.select("doc_id", "stratum", *names, "base_failed", "failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"))
