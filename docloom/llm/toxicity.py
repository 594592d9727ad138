"""Toxicity by weak supervision.

Voters look at a text: terms of a seed lexicon and of a lexicon induced from the labelled
training rows (words and word beginnings that toxic texts have and others lack), and
patterns (several different terms, their density, direct address, shouting, masked
letters, none of all terms). A generative label model gives each voter a rate of each vote
for toxic and for clean texts and estimates them with the texts' posteriors by expectation
and maximization, from the majority of the votes; what two voters share beyond what the
class explains is their correlation, and correlated voters count for less. It sees the
votes alone, on labelled and unlabelled rows alike: labels choose the terms of the lexicon
and the prior, but no label is a vote or a start. A linear classifier over the terms of the
vocabulary is trained on the posteriors and scores every text.

Defined results: a null or empty text has no term and gets the probability of the offset;
equal texts get equal scores; a very long text is scored whole; without labelled rows of
both kinds the seed lexicon alone decides; an empty table gives no rows. Other columns are
ignored.

Data sizes: the sample has at most PER_LABEL rows a label and UNLABELLED rows without one.
Its terms are counted by Spark; the driver gets, for each row of the sample, those of at most
VOCABULARY terms that it has. Every text is scored whole, where it is, with weights of at
most VOCABULARY terms.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import folds, scratch, wordvec

PER_LABEL = 3000
#: Rows without a label that the label model and the classifier see, too.
UNLABELLED = 3000
VOCABULARY, VOTERS = 20_000, 256
#: A term is in the vocabulary if so many texts of the sample have it.
LEAST_TEXTS = 3
#: An induced term stands for toxic texts in this share of the labelled texts that have it.
SURE = 0.7
PREFIXES = (4, 5)
SEEDS = (
    "idiot idiots moron morons stupid pathetic worthless disgusting scum trash loser losers clown dumb imbecile fool jerk "
    "hate vermin filthy creep freak coward liar parasite ugly garbage shut idiote crétin imbécile abruti ordure connard "
    "dummkopf trottel abschaum idioten versager widerlich idiota imbécil estúpido basura asqueroso inútil payaso"
).split()
#: Words that address the reader, and letters hidden in a word.
ADDRESS = "you your yours yourself you're u ur tu toi ton ta tes vous votre du dich dir dein deine tú tus usted ustedes eres".split()
_MASKED = re.compile(rb"[A-Za-z][*#$]+[A-Za-z]")
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_KIND = [np.uint64(0), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)]


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row and hash of each term (words without signs at their ends, A-Z lower-cased, and their first bytes), and words of each row."""
    w = wordvec.words(data, offsets)
    starts, ends = w.starts.copy(), w.ends.copy()
    while True:
        more = (starts < ends) & _PUNCTUATION[data[np.minimum(starts, max(0, len(data) - 1))]] if len(data) else np.zeros(0, bool)
        if not more.any():
            break
        starts += more
    while True:
        more = (starts < ends) & _PUNCTUATION[data[ends - 1]] if len(data) else np.zeros(0, bool)
        if not more.any():
            break
        ends -= more
    full = starts < ends
    low = wordvec.lowered(data)
    spans = [(starts[full], ends[full], w.row[full])]
    for n in PREFIXES:
        longer = full & (ends - starts > n)
        spans.append((starts[longer], starts[longer] + n, w.row[longer]))
    rows, values = [], []
    for kind, (a, b, row) in zip(_KIND, spans):
        rows.append(row)
        values.append(wordvec.word_hashes(wordvec.Words(data, offsets, a, b, row, w.first), low) ^ kind)
    return np.concatenate(rows), np.concatenate(values), np.diff(w.first)


def distinct(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return rows[new], values[new]


def seed_hashes(words: list[str] = SEEDS) -> np.ndarray:
    data, offsets = wordvec.buffers(pa.array(words))
    row, h, _ = terms(data, offsets)
    return h[: len(words)]


@dataclass
class LabelModel:
    """Rates of the votes -1, 0 and 1 by class, the prior and each voter's discount for its correlations."""

    rates: np.ndarray  # 2 x voters x 3
    prior: float
    discount: np.ndarray
    correlation: np.ndarray

    @staticmethod
    def of(votes: np.ndarray, weights: np.ndarray, prior: float, start: np.ndarray | None = None, rounds: int = 25) -> LabelModel:
        """votes: texts x voters, of -1, 0 and 1. The prior stays as given; all else is estimated, from posteriors to start with or a majority."""
        n, m = votes.shape
        w = weights / weights.sum() if n else weights
        share = (votes == 1).sum(1) - 2.0 * (votes == -1).sum(1)
        posterior = np.where(share > 0, 0.95, np.where(share < 0, 0.02, prior)) if start is None else start
        flags = np.stack([votes == -1, votes == 0, votes == 1], 2).astype(np.float64)
        discount, correlation = np.ones(m), np.zeros((m, m))
        rates = np.full((2, m, 3), 1 / 3)
        for k in range(rounds):
            for c, p in ((0, 1 - posterior), (1, posterior)):
                weight = w * p
                rates[c] = (np.tensordot(weight, flags, 1) + 1e-4 * (1 + flags.mean(0))) / (weight.sum() + 3e-4)
            rates /= rates.sum(2, keepdims=True)
            if k in (5, 15):
                mean = rates @ np.array([-1.0, 0.0, 1.0])
                rest = votes - ((1 - posterior)[:, None] * mean[0] + posterior[:, None] * mean[1])
                rest *= np.sqrt(w)[:, None]
                spread = np.sqrt((rest**2).sum(0)) + 1e-9
                correlation = rest.T @ rest / spread / spread[:, None]
                np.fill_diagonal(correlation, 0)
                discount = 1 / (1 + np.where(correlation > 0.1, correlation, 0).sum(1))
            posterior = LabelModel(rates, prior, discount, correlation).posterior(votes)
        return LabelModel(rates, prior, discount, correlation)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        ratio = np.log(self.rates[1]) - np.log(self.rates[0])
        ratio = np.clip(ratio, -8, 8) * self.discount[:, None]
        z = np.log(self.prior / (1 - self.prior)) + sum(((votes == v) @ ratio[:, v + 1]) for v in (-1, 0, 1))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Classifier:
    hashes: np.ndarray
    weights: np.ndarray
    offset: float

    def __post_init__(self) -> None:
        order = np.argsort(self.hashes)
        self.hashes, self.weights = self.hashes[order], self.weights[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        z = np.full(n, self.offset)
        if len(data) and len(self.hashes):
            row, h, _ = terms(data, offsets)
            some = self.maybe[(h & np.uint64((1 << 20) - 1)).astype(np.int64)]
            row, h = row[some], h[some]
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            known = self.hashes[at] == h
            pair = np.unique(row[known] * np.int64(len(self.hashes)) + at[known])
            z += np.bincount(pair // len(self.hashes), self.weights[pair % len(self.hashes)], n)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(row: np.ndarray, term: np.ndarray, n: int, m: int, target: np.ndarray, weights: np.ndarray, *, sparse: float = 1e-4, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets over presence of terms, by proximal Adam over all rows; sparse is the weight of the sum of absolute values."""
    w, b = np.zeros(m), 0.0
    weight = weights / weights.sum()
    share = float(np.clip((weight * target).sum(), 1e-3, 1 - 1e-3))
    b = float(np.log(share / (1 - share)))
    m1, m2, c1, c2 = np.zeros(m), np.zeros(m), 0.0, 0.0
    for k in range(1, steps + 1):
        z = b + np.bincount(row, w[term], n)
        d = (1 / (1 + np.exp(-z)) - target) * weight
        g = np.bincount(term, d[row], m)
        gb = float(d.sum())
        m1, m2, c1, c2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g, 0.9 * c1 + 0.1 * gb, 0.99 * c2 + 0.01 * gb * gb
        rate = 0.1 * (0.5 + 0.5 * np.cos(np.pi * k / steps)) + 1e-3
        step = rate / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-6)
        w -= step * (m1 / (1 - 0.9**k))
        w = np.sign(w) * np.maximum(np.abs(w) - step * sparse, 0)
        b -= rate * (c1 / (1 - 0.9**k)) / (np.sqrt(c2 / (1 - 0.99**k)) + 1e-9)
    return w, b


_TERM_NAMES = ["_id", "label", "terms", "n_words", "upper", "direct", "masked"]


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    address = seed_hashes(ADDRESS)
    for batch in batches:
        data, offsets = wordvec.buffers(batch.column(1))
        for a, b in wordvec.runs(offsets):
            own, cut = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            row, h, n_words = terms(own, cut)
            direct = np.bincount(row[np.isin(h, address)], minlength=b - a)
            raw = own.tobytes()
            masked = np.array([_MASKED.search(raw, x, y) is not None for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())], bool)
            row, h = distinct(row, h)
            first = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
            upper = np.add.reduceat(np.append((own >= 65) & (own <= 90), False).astype(np.int64), cut[:-1]) * (np.diff(cut) > 0)
            letters = np.maximum(1, np.diff(cut))
            lists = pa.ListArray.from_arrays(pa.array(first), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), lists, pa.array(n_words, pa.int64()), pa.array(upper / letters), pa.array(direct, pa.int64()), pa.array(masked)], names=_TERM_NAMES)


def voters(row: np.ndarray, term: np.ndarray, n: int, lexicon: np.ndarray, n_words: np.ndarray, upper: np.ndarray, direct: np.ndarray, masked: np.ndarray) -> np.ndarray:
    """texts x voters: a voter for each lexicon term and one for each pattern. direct and masked: words of address, and whether a word hides letters."""
    votes = np.zeros((n, len(lexicon) + 6), np.int8)
    place = {int(t): k for k, t in enumerate(lexicon)}
    at = np.array([place.get(int(t), -1) for t in term], np.int64)
    votes[row[at >= 0], at[at >= 0]] = 1
    hits = (votes[:, : len(lexicon)] == 1).sum(1)
    votes[:, -6] = np.where(direct * 50 >= np.maximum(n_words, 1), 1, 0)
    votes[:, -5] = np.where(masked, 1, 0)
    votes[:, -4] = np.where(hits >= 2, 1, 0)
    votes[:, -3] = np.where(hits * 100 >= np.maximum(n_words, 1), 1, 0) * (hits > 0)
    votes[:, -2] = np.where((upper > 0.5) & (hits > 0), 1, 0)
    votes[:, -1] = np.where(hits == 0, -1, 0)
    return votes


def _spread(ranked: list[int], common: set[int], row: np.ndarray, term: np.ndarray) -> list[int]:
    """The ranked terms and the common ones, but none whose texts are nearly all among those of one before it."""
    order = np.argsort(term, kind="stable")
    first = np.searchsorted(term[order], np.arange((int(term.max()) if len(term) else -1) + 2))
    texts = lambda k: set(row[order[first[k] : first[k + 1]]].tolist())
    chosen: list[tuple[int, set[int]]] = []
    for k in [*ranked, *sorted(common - set(ranked))]:
        own = texts(k)
        if own and len(chosen) < VOTERS and all(len(own & other) < 0.9 * len(own) for _, other in chosen):
            chosen.append((k, own))
    return [k for k, _ in chosen]


def trained(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", folds_: int = 4, held_out: int = 2, per_label: int = PER_LABEL, unlabelled: int = UNLABELLED) -> tuple[Classifier, LabelModel | None]:
    """The classifier, and the label model that made its targets (None: the seed lexicon decides)."""
    sample, weights = folds.sampled(docs, labels, label_col, folds=folds_, held_out=held_out, per_label=per_label)
    seeds = seed_hashes()
    alone = Classifier(seeds.copy(), np.full(len(seeds), 3.0), -3.0)
    if set(weights) != {0, 1}:
        return alone, None
    kind = sample.schema["_id"].dataType.simpleString()
    more = folds.unlabelled(docs, labels, label_col, folds=folds_, held_out=held_out, most=unlabelled)
    rows = scratch.written(sample.select("_id", "text", "label").unionByName(more).mapInArrow(_term_rows, f"_id {kind}, label int, terms array<long>, n_words long, upper double, direct long, masked boolean"), "toxic-terms")
    counted = rows.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    counted = counted.where(F.col("pos") + F.col("neg") >= LEAST_TEXTS)
    all_pos, all_neg = (float(x or 0) * weights[c] for c, x in zip((1, 0), counted.agg(F.sum("pos"), F.sum("neg")).first()))
    vocabulary = counted.orderBy((F.col("pos") / (F.col("neg") * F.lit(weights[0] / weights[1]) + 1)).desc(), "term").limit(VOCABULARY).toPandas()
    known = vocabulary["term"].to_numpy(np.int64)
    pos, neg = vocabulary["pos"].to_numpy(np.float64) * weights[1], vocabulary["neg"].to_numpy(np.float64) * weights[0]
    order = np.sort(known)
    sent = order.copy()

    def restrict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            at = np.minimum(np.searchsorted(sent, flat), max(0, len(sent) - 1))
            hit = sent[at] == flat if len(sent) else np.zeros(len(flat), bool)
            cut = np.searchsorted(owner[hit], np.arange(len(lists) + 1)).astype(np.int32)
            own = pa.ListArray.from_arrays(pa.array(cut), pa.array(at[hit].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), own, *batch.columns[3:]], names=_TERM_NAMES)

    held = rows.mapInArrow(restrict, f"_id {kind}, label int, terms array<int>, n_words long, upper double, direct long, masked boolean").toPandas()  # at most 2 * per_label + unlabelled rows
    held = held.sort_values("_id", kind="stable")
    n = len(held)
    sizes = np.array([len(t) for t in held["terms"]], np.int64)
    row = np.repeat(np.arange(n), sizes)
    term = np.concatenate([np.asarray(t, np.int64) for t in held["terms"]]) if n else np.zeros(0, np.int64)
    label = held["label"].to_numpy(np.float64)  # nan: none
    row_weight = np.where(label == 1, weights[1], weights[0])
    free = np.isnan(label)
    row_weight[free] = row_weight[~free].sum() / max(1, free.sum())  # rows without a label weigh as much as those with one
    place = {int(t): k for k, t in enumerate(order)}
    mean = (all_pos + 1) / (all_pos + all_neg + 2)  # of all counted terms, also those outside the vocabulary
    surety = (pos + 2 * mean) / (pos + neg + 2)
    toxic = np.flatnonzero((surety > SURE) & (vocabulary["pos"].to_numpy() >= LEAST_TEXTS))
    toxic = toxic[np.argsort(-vocabulary["pos"].to_numpy()[toxic], kind="stable")]
    common = {place[int(s)] for s in seeds.view(np.int64) if int(s) in place}
    lexicon = _spread([place[int(known[k])] for k in toxic], common, row, term)
    if not lexicon:
        return alone, None
    votes = voters(row, term, n, np.array(lexicon), *(held[c].to_numpy() for c in _TERM_NAMES[3:]))
    prior = float(row_weight[label == 1].sum() / row_weight[~free].sum())
    model = LabelModel.of(votes, row_weight, prior)
    w, b = fit_linear(row, term, n, len(order), model.posterior(votes), row_weight)
    keep = np.abs(w) > 1e-3
    return Classifier(order.view(np.uint64)[keep], w[keep], b), model


def scored(docs: DataFrame, classifier: Classifier, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted of each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    held = pickle.dumps(classifier, 5)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(held)
        for batch in batches:
            data, offsets = wordvec.buffers(batch.column(1))
            out = [own.score(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in wordvec.runs(offsets)]
            p = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(score, f"doc_id {kind}, score double, predicted int")
