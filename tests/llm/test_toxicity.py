import random
import zlib

import numpy as np
import pyarrow as pa

from docloom.llm import folds, toxicity, wordvec
from docloom.llm.queries import op5_toxicity
from tests.llm.helpers import documents, labels, prose

SMALL = "/root/testdata/sf0.01"


def made(n=600):
    g, rows, marks = random.Random(8), [], []
    for i in range(n):
        w = prose(1000 + i, g.randint(5, 60)).split(" ")
        toxic = g.random() < 0.25
        if toxic:
            for _ in range(g.randint(1, 3)):
                w.insert(g.randrange(len(w)), g.choice(["Zuktok!", "zuktar", "grolm,", "IDIOT"]))
        rows.append((i, " ".join(w)))
        if i % 3:
            marks.append((i, 1, int(toxic)))
    return rows, marks


def test_held_out_labels(spark):
    rows, marks = made()
    docs = documents(spark, rows)
    classifier, model = toxicity.trained(docs, labels(spark, marks))
    out = {r.doc_id: r for r in toxicity.scored(docs, classifier).collect()}
    assert len(out) == len(rows)
    held = [(i, t) for i, _, t in marks if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum(out[i].predicted == t for i, t in held)
    assert len(held) > 50 and right >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out.values())
    accuracy = model.rates[1][:, 2] - model.rates[0][:, 2]
    assert np.isfinite(model.rates).all() and accuracy.max() > 0.2


def test_labels_of_the_held_out_fold_are_not_learned(spark):
    rows, marks = made(200)
    docs = documents(spark, rows)
    other = [(i, q, 1 - t) if zlib.crc32(str(i).encode()) % 4 == 2 else (i, q, t) for i, q, t in marks]
    a = toxicity.trained(docs, labels(spark, marks))[0]
    b = toxicity.trained(docs, labels(spark, other))[0]
    assert a.hashes.tolist() == b.hashes.tolist() and a.weights.tolist() == b.weights.tolist() and a.offset == b.offset


def test_awkward_rows_and_labels(spark):
    docs = documents(spark)
    marks = [(1, 1, 0), (1, 1, 1), (2, None, None), (None, 1, 1), (999, 1, 1), (3, 0, 0)]
    out = toxicity.scored(docs, toxicity.trained(docs, labels(spark, marks))[0])
    assert out.count() == docs.count() and out.where("score is null or predicted is null").count() == 0
    assert toxicity.scored(documents(spark, []), toxicity.trained(documents(spark, []), labels(spark, []))[0]).count() == 0


def test_the_seed_lexicon_decides_without_labels(spark):
    docs = documents(spark, [(1, "You IDIOT!! worthless scum."), (2, "a kind word"), (3, None)])
    out = {r.doc_id: r.predicted for r in toxicity.scored(docs, toxicity.trained(docs, labels(spark, []))[0]).collect()}
    assert out == {1: 1, 2: 0, 3: 0}


def test_terms_have_no_signs_at_their_ends():
    rows = ["Idiot", "idiot!!", "$$$IDIOT,", "***", ""]
    data, offsets = wordvec.buffers(pa.array(rows))
    row, h, n = toxicity.terms(data, offsets)
    sets = [set(h[row == k].tolist()) for k in range(5)]
    assert sets[0] == sets[1] == sets[2] and not sets[3] and not sets[4] and n.tolist() == [1, 1, 1, 1, 0]


def test_address_and_masked_letters_vote_without_a_known_term():
    rows = ["you are a nice cat", "what a b*st day", "a quiet day by the sea", ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(rows), pa.array([1, 1, 0, 0], pa.int32())], names=["_id", "text", "label"])
    out = next(toxicity._term_rows(iter([batch])))
    none = np.zeros(0, np.int64)
    votes = toxicity.voters(none, none, 4, none, *(out.column(k).to_numpy(zero_copy_only=False) for k in range(3, 7)))
    assert (votes == 1).any(1).tolist() == [True, True, False, False] and (votes[:, -1] == -1).all()


def test_label_model_tells_good_voters_from_bad_and_correlated_ones():
    g = np.random.default_rng(5)
    n = 4000
    y = g.random(n) < 0.3
    voter = lambda hit, wrong: np.where(g.random(n) < np.where(y, hit, wrong), 1, 0)
    good, fair, noise = voter(0.9, 0.02), voter(0.6, 0.05), voter(0.3, 0.3)
    same = voter(0.5, 0.2)
    votes = np.stack([good, fair, noise, same, same, same, np.where(good + fair == 0, -1, 0)], 1)
    model = toxicity.LabelModel.of(votes, np.ones(n), 0.3)
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.93
    gap = model.rates[1][:, 2] - model.rates[0][:, 2]
    assert gap[0] > gap[1] > gap[2] and model.discount[3] < 0.5 < model.discount[2] and model.correlation[3, 4] > 0.9


def plain_model(votes, weights, prior, rounds):
    """Expectation and maximization written out, text by text and voter by voter."""
    n, m = len(votes), len(votes[0])
    total = sum(weights)
    post = []
    for v in votes:
        s = sum(x == 1 for x in v) - 2 * sum(x == -1 for x in v)
        post.append(0.95 if s > 0 else 0.02 if s < 0 else prior)
    discount = [1.0] * m
    for k in range(rounds):
        rates = [[None] * m, [None] * m]
        for c in (0, 1):
            own = [w / total * (p if c else 1 - p) for w, p in zip(weights, post)]
            for j in range(m):
                r = []
                for vote in (-1, 0, 1):
                    share = sum(v[j] == vote for v in votes) / n
                    r.append((sum(w for w, v in zip(own, votes) if v[j] == vote) + 1e-4 * (1 + share)) / (sum(own) + 3e-4))
                rates[c][j] = [x / sum(r) for x in r]
        if k in (5, 15):
            mean = [[r[2] - r[0] for r in rates[c]] for c in (0, 1)]
            rest = [[v[j] - (1 - p) * mean[0][j] - p * mean[1][j] for j in range(m)] for v, p in zip(votes, post)]
            dot = lambda a, b: sum(w / total * r[a] * r[b] for w, r in zip(weights, rest))
            for a in range(m):
                over = [dot(a, b) / (dot(a, a) ** 0.5 + 1e-9) / (dot(b, b) ** 0.5 + 1e-9) for b in range(m) if b != a]
                discount[a] = 1 / (1 + sum(x for x in over if x > 0.1))
        post = []
        for v in votes:
            z = np.log(prior / (1 - prior))
            for j in range(m):
                z += discount[j] * min(8, max(-8, np.log(rates[1][j][v[j] + 1]) - np.log(rates[0][j][v[j] + 1])))
            post.append(1 / (1 + np.exp(-min(30, max(-30, z)))))
    return rates, discount, post


def test_label_model_equals_a_plain_one():
    g = np.random.default_rng(9)
    y = g.random(120) < 0.3
    votes = np.stack([np.where(g.random(120) < np.where(y, a, b), 1, 0) for a, b in [(0.8, 0.05), (0.5, 0.1), (0.4, 0.4)]] + [np.where(g.random(120) < 0.3, -1, 0)], 1)
    votes = np.concatenate([votes, votes[:, :1]], 1)
    weights = g.random(120) + 0.5
    model = toxicity.LabelModel.of(votes, weights, 0.25)
    rates, discount, post = plain_model(votes.tolist(), weights.tolist(), 0.25, 25)
    assert np.allclose(model.rates, rates) and np.allclose(model.discount, discount) and np.allclose(model.posterior(votes), post)


def test_labels_are_no_votes(spark, monkeypatch):
    """The label model sees the votes alone: rows of one text vote alike, whatever their labels, and none is a start."""
    rows, marks = made(300)
    text = rows[1][1]
    rows += [(5000 + k, text) for k in range(8)]
    marks += [(5000 + k, 1, k % 2) for k in range(4)]
    seen, of = [], toxicity.LabelModel.of
    monkeypatch.setattr(toxicity.LabelModel, "of", staticmethod(lambda *args: seen.append(args) or of(*args)))
    toxicity.trained(documents(spark, rows), labels(spark, marks))
    (votes, weights, prior), = seen
    n = sum(zlib.crc32(str(i).encode()) % 4 != 2 for i, _ in rows)
    assert len(votes) == n and len(set(map(tuple, votes[-sum(zlib.crc32(str(5000 + k).encode()) % 4 != 2 for k in range(8)) :].tolist()))) == 1


def test_unlabelled_rows_are_bounded_and_outside_the_held_out_fold(spark):
    rows, marks = made(300)
    own = folds.unlabelled(documents(spark, rows), labels(spark, marks), "toxic", folds=4, held_out=2, most=20).collect()
    assert len(own) == 20 and not {r["_id"] for r in own} & {i for i, _, _ in marks}
    assert all(zlib.crc32(str(r["_id"]).encode()) % 4 != 2 and r.label is None for r in own)


def test_the_query_on_the_given_table(spark):
    out = op5_toxicity(spark, SMALL).collect()
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    held = [r for r in out if r.doc_id in marks and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    caught = [r.predicted for r in held if marks[r.doc_id]]
    wrong = [r.predicted for r in held if not marks[r.doc_id]]
    assert sum(caught) >= 0.5 * len(caught) and sum(wrong) <= 0.03 * len(wrong)  # 37 toxic texts to learn from


def test_sample_is_bounded(spark):
    rows, marks = made(300)
    sample, weights = folds.sampled(documents(spark, rows), labels(spark, marks), "toxic", folds=4, held_out=2, per_label=10)
    assert sample.count() == 20 and weights[0] > weights[1] > 1
