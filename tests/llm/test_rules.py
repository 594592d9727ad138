import numpy as np
import pyarrow as pa

from docloom.llm import rules
from tests.llm.helpers import documents, labels, prose, texts, words

SYMBOLS = "#*$%&|<>"


def plain_stats(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    seen, repeated = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            for i in places:
                repeated |= set(range(i, i + 8))
    return [len(w), sum(map(len, w)), sum(c in SYMBOLS for c in text), len(lines) - len(set(lines)), len(repeated), len(lines), sum("A" <= c <= "Z" for c in text), text.count("!")]


def awkward():
    out = [t for _, t in texts()]
    loop = " ".join(["la"] * 30)
    out += [loop, prose(3, 20) + " " + prose(3, 20), "a\n \na\na ", "x " * 7, "x " * 8, "x " * 9, "##\t*!\n##\t*!", prose(5, 12) + "\n" + loop + "\n" + prose(6, 9)]
    return out


def test_stats_equal_plain_ones():
    rows = awkward()
    got = np.array(rules.stats_of(pa.array(rows))).T.tolist()
    assert got == [plain_stats(t) for t in rows]
    assert rules.stats_of(pa.array([], pa.string()))[0].tolist() == []


def exact_upper(k, n, level):
    low, high = 0.0, 1.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if k < n and rules.binomial_below(k, n, mid) > level else (low, mid)
    return high


def test_binomial_bounds():
    assert abs(rules.binomial_below(2, 5, 0.5) - 0.5) < 1e-12
    assert abs(rules.binomial_below(0, 100, 0.03) - 0.97**100) < 1e-12
    assert abs(exact_upper(0, 50, 0.05) - (1 - 0.05 ** (1 / 50))) < 1e-9
    for k, n, share, level in [(0, 100, 0.03, 0.05), (0, 98, 0.03, 0.05), (3, 400, 0.02, 0.05), (4, 400, 0.02, 0.05)]:
        assert rules.within(k, n, share, level) == (exact_upper(k, n, level) <= share)
    assert not rules.within(0, 0, 0.5, 0.5)


def test_the_sequence_of_tests_ends_at_the_first_failure():
    good, bad = np.zeros(rules.STEPS + 1, int), np.zeros(rules.STEPS + 1, int)
    bad[3], good[10], bad[12], good[-1] = 50, 40, 500, 960
    assert rules.chosen(good, bad, 0.02, 0.01) == 3
    assert rules.chosen(good, bad, 0.2, 0.01) == 3  # a cutoff past the good ones costs more than it brings
    good[10] = 4
    assert rules.chosen(good, bad, 0.02, 0.01) == 12
    assert rules.chosen(np.zeros(rules.STEPS + 1, int), bad, 0.02, 0.01) is None


def test_steps_and_cutoffs_agree(spark):
    """A document is rejected at a step just where some value is above its rule's cutoff there."""
    docs = documents(spark, [(k, t) for k, t in enumerate(awkward())] + [(900 + k, prose(k, 25) + " $" * k) for k in range(30)])
    rows = rules.stepped(rules.measured(docs)).select("step", "steps", *[v.alias(f"v_{n}") for n, (v, _, _) in rules.rules().items()]).collect()
    for r in rows:
        first = rules.STEPS
        for name, (_, loose, strict) in rules.rules().items():
            own = [s for s in range(rules.STEPS) if r[f"v_{name}"] > loose - s * rules.width(loose, strict) + 1e-9]
            low = [s for s in range(rules.STEPS) if r[f"v_{name}"] > loose - s * rules.width(loose, strict) - 1e-9]
            assert (low or [rules.STEPS])[0] <= r.steps[name] <= (own or [rules.STEPS])[0]
            first = min(first, r.steps[name])
        assert r.step == first


def test_the_allowed_share_is_kept_as_often_as_the_level_says():
    """Strata of 400 good labels, each step rejecting a known share of good texts: the chosen step's true share is over the limit in 5 % of the trials at most."""
    g = np.random.default_rng(5)
    share = np.concatenate([np.linspace(0.0005, 0.05, rules.STEPS), [1.0]])  # of good texts rejected up to a step
    p = np.diff(share, prepend=0)
    over = used = 0
    for _ in range(400):
        bad = np.concatenate([np.full(rules.STEPS, 20), [0]])
        step = rules.chosen(g.multinomial(400, p), bad, 0.02, 0.05)
        used += step is not None
        over += step is not None and share[step] > 0.02
    assert used > 200 and over <= 0.05 * 400 + 3 * (400 * 0.05 * 0.95) ** 0.5


def test_the_query_rejects_by_its_cutoffs(spark):
    """On the given tables some texts are rejected that the base rules let through, and hardly a good one."""
    for sf in ("sf0.01", "sf0.1"):
        docs, marks = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
        out = rules.judged(docs, marks).join(marks, "doc_id").where("not base_failed")
        bad, good = (out.where(f"quality = {k}") for k in (0, 1))
        assert bad.where("not kept").count() > 0.3 * bad.count() and good.where("not kept").count() <= 0.02 * good.count()


def corpus(n=3000):
    rows, marks = [], []
    for i in range(n):
        body = prose(i % 40, 30) + f" {i}"
        rows.append((i, body + " ###" * 30 if i % 5 == 0 else body))
        marks.append((i, int(i % 5 > 0), 0))
    return rows, marks


def test_cutoffs_reject_the_bad_and_few_good(spark):
    rows, marks = corpus()
    docs = documents(spark, rows)
    out = rules.judged(docs, labels(spark, marks), allowed=0.2).collect()
    assert len(out) == len(rows)
    for r in out:
        want = plain_stats(dict(rows)[r.doc_id])
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == want[:5]
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and (not r.kept or not r.base_failed)
    assert sum(r.kept for r in out if r.doc_id % 5) >= 0.98 * sum(r.doc_id % 5 > 0 for r in out)
    assert not any(r.kept for r in out if r.doc_id % 5 == 0)


def test_too_few_labels_reject_nothing_more(spark):
    rows, marks = corpus(60)
    out = rules.judged(documents(spark, rows), labels(spark, marks)).collect()
    assert all(r.kept != r.base_failed for r in out)


def test_awkward_rows_and_labels(spark):
    docs = documents(spark)
    out = rules.judged(docs, labels(spark, [(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, None), (999, 0, 0)])).collect()
    assert len(out) == docs.count() and all(r.kept is not None and r.base_failed is not None for r in out)
    assert rules.judged(documents(spark, []), labels(spark, [])).count() == 0
