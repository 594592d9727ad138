import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import neardup, wordvec
from tests.llm.helpers import documents, prose, shingles, texts, words


def plain(rows, percent=70):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    least = {}
    for k, (i, _) in enumerate(rows):
        if sets[k] and i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    out = []
    for k, (i, _) in enumerate(rows):
        c = least.get(root(k)) if sets[k] else i
        out.append((i, len(sets[k]), c, i == c))
    return sorted(out, key=repr)


def group(seed, copies, changes):
    """A text and copies of it that each differ from it in a few words of their own."""
    g, base = random.Random(seed), prose(seed, 150).split(" ")
    out = [" ".join(base)]
    for _ in range(copies):
        w = list(base)
        for _ in range(g.randint(1, changes)):
            w[g.randrange(len(w))] = f"new{g.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def grown():
    rows = texts()
    i = 1000
    for seed, (copies, changes) in enumerate([(1, 3), (4, 5), (30, 4), (12, 2), (60, 5)]):
        for t in group(100 + seed, copies, changes):
            rows.append((i, t))
            i += 1
    return rows


@pytest.mark.parametrize("broadcast", [False, True])
def test_equals_brute_force(spark, broadcast, monkeypatch):
    if not broadcast:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    monkeypatch.setattr(neardup, "LIST_PART", 512 if broadcast else 2)
    rows = grown() if broadcast else texts()
    try:
        out = neardup.clustered(documents(spark, rows)).select("doc_id", "n_shingles", "component_id", "kept")
        assert sorted((tuple(r) for r in out.collect()), key=repr) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def straddling(seed, n=40):
    """Texts of one family whose similarities lie on both sides of 70 percent."""
    g = random.Random(seed)
    base = [f"b{seed}x{k}" for k in range(110)]
    out = []
    for k in range(n):
        w = list(base)
        for i in g.sample(range(len(w)), g.choice([1, 2, 2, 3])):
            w[i] = f"n{seed}x{g.randrange(6)}y{i}"
        cut = g.randrange(0, 12)
        out.append(" ".join(w[cut:] if g.random() < 0.5 else w[: len(w) - cut]))
    return out


def test_groups_that_straddle_the_threshold(spark):
    """Many groups beside one another, and some alone: the same components as brute force, group by group."""
    groups = [[(1000 * s + k, t) for k, t in enumerate(straddling(s))] for s in range(110)]
    plains = [plain(rows) for rows in groups]
    want = {i: c for own in plains for i, _, c, _ in own}
    parted = sum(len({c for _, _, c, _ in own}) > 1 for own in plains)
    out = neardup.clustered(documents(spark, [r for rows in groups for r in rows])).select("doc_id", "component_id").collect()
    assert parted > 60 and {r.doc_id: r.component_id for r in out} == want
    alone = neardup.clustered(documents(spark, groups[3])).collect()
    assert {r.doc_id: r.component_id for r in alone} == {i: want[i] for i, _ in groups[3]}


def test_less_than_the_bands_find_is_refused(spark):
    with pytest.raises(ValueError):
        neardup.clustered(documents(spark), percent=60)


def test_left_over(spark, monkeypatch):
    """With no round of stars that counts and no plausible pair, the exact join alone finds all links."""
    monkeypatch.setattr(neardup, "least_agreeing", lambda percent: 1000)
    monkeypatch.setattr(neardup, "LARGE", 0)
    rows = [(k, t) for k, t in enumerate(group(77, 20, 4) + group(78, 3, 9))]
    out = neardup.clustered(documents(spark, rows)).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted((tuple(r) for r in out.collect()), key=repr) == plain(rows)


def alike(n, own, shared):
    """n texts of 150 shingles of one passage and own ones; each two in a row share some of these, if shared."""
    passage = [f"p{k}" for k in range(154)]
    tail = lambda k: [f"s{k // 2}x{i}" for i in range(shared)] + [f"t{k}x{i}" for i in range(own - shared)]
    return [(k, " ".join(passage + tail(k))) for k in range(n)]


@pytest.mark.parametrize("own, short", [(33, neardup.SHORT_LIST), (40, 1)])
def test_links_before_a_background_just_below_the_threshold(spark, own, short, monkeypatch):
    monkeypatch.setattr(neardup, "SHORT_LIST", short)
    rows = alike(80, own, 2 if own == 33 else 14)
    want = plain(rows)
    assert all(c == i // 2 * 2 for i, _, c, _ in want)
    out = neardup.clustered(documents(spark, rows)).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted((tuple(r) for r in out.collect()), key=repr) == want


def test_link_of_two_that_are_never_centres(spark):
    w = prose(5, 200).split(" ")
    c1, m1, m2, c2 = rows = [(k, " ".join(w[15 * k : 15 * k + 100])) for k in range(4)]
    docs = documents(spark, rows)
    bands = F.when(F.col("doc_id").isin(c1[0], c2[0]), F.array(*map(F.lit, (1, 2, 3)))).otherwise(F.array(F.lit(1))).cast("array<long>")
    feats = neardup.features(docs).withColumn("bands", bands)
    labels = {r.node: r.label for r in neardup.links(docs, feats)[1].collect()}
    assert len(labels) == 4 and len(set(labels.values())) == 1


def test_chain_of_links_is_one_component(spark):
    w = prose(5, 200).split(" ")
    rows = [(k, " ".join(w[8 * k : 8 * k + 100])) for k in range(12)]
    out = neardup.clustered(documents(spark, rows)).collect()
    assert {r.component_id for r in out} == {0} and all(r.n_links >= 1 for r in out)


def test_deduplicated_keeps_one_of_each(spark):
    docs = documents(spark)
    out = neardup.deduplicated(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    kept = {i for i, _, _, k in plain(texts()) if k and i is not None}
    assert sorted(i for i in ids if i is not None) == sorted(kept)


def shuffled(spark):
    """Bytes that each stage so far wrote for a shuffle."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    seq = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in map(seq.apply, range(seq.size()))}


def test_deduplicated_shuffles_no_text_without_need(spark):
    """On tables beyond the broadcast threshold, texts that have no near copy stay where they are."""
    g = random.Random(11)
    rows = [(k, " ".join(f"{g.getrandbits(64):x}" for _ in range(1500))) for k in range(60)]
    rows += [(100 + k, t + " end") for k, t in rows[:2]] + [(200, rows[9][1]), (5, rows[5][1])]
    docs = documents(spark, rows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = shuffled(spark)
        ids = sorted(r.doc_id for r in neardup.deduplicated(docs).collect())
        moved = sum(v for k, v in shuffled(spark).items() if k not in before)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert ids == list(range(60))
    assert moved < 0.3 * sum(len(t) for _, t in rows)


@pytest.mark.parametrize("marks", [1, 64])
def test_deduplicated_when_bits_are_shared(spark, marks, monkeypatch):
    """Kept rows that share a bit with dropped ones, and repeated ones, are told apart exactly."""
    monkeypatch.setattr(neardup, "MARKS", marks)
    rows = grown() + [(300, "all alone here and now"), (301, "all alone here and now"), (301, "all alone here and now")]
    ids = [r.doc_id for r in neardup.deduplicated(documents(spark, rows)).collect()]
    kept = {i for i, _, _, k in plain(rows) if k}
    assert len(ids) - ids.count(None) == len(set(ids) - {None}) and set(ids) == kept


def test_empty_and_single(spark):
    assert neardup.clustered(documents(spark, [])).count() == 0
    assert neardup.deduplicated(documents(spark, [(1, "a b c d e f")])).count() == 1
    assert neardup.deduplicated(documents(spark, [(1, None), (2, None)])).count() == 2


def test_components(spark):
    g = random.Random(2)
    for n, m in ((30, 20), (60, 90), (40, 0)):
        edges = [(g.randrange(n), g.randrange(n)) for _ in range(m)] + [(k, k + 1) for k in range(100, 120)]
        got = {r.node: r.label for r in neardup.components(spark.createDataFrame(edges, "a int, b int")).collect()}
        label = {x: x for e in edges if e[0] != e[1] for x in e}
        for _ in label:
            for a, b in edges:
                if a != b:
                    label[a] = label[b] = min(label[a], label[b])
        assert got == label


def test_sets_and_signatures():
    rows = [t or "" for _, t in texts()]
    data, offsets = wordvec.buffers(pa.array(rows))
    values, first = neardup.sets(data, offsets)
    assert np.diff(first).tolist() == [len(shingles(t)) for t in rows]
    split = np.split(values, first[1:-1])
    for a in range(len(rows)):
        for b in range(a):
            assert len(np.intersect1d(split[a], split[b])) == len(shingles(rows[a]) & shingles(rows[b]))
    signature = neardup.signatures(values, first)
    for k, own in enumerate(split):
        assert (set(signature[k].tolist()) <= set(own.tolist())) if len(own) else (signature[k] == neardup._EMPTY).all()


def test_densified_values_estimate_similarity():
    g = np.random.default_rng(3)
    for n in (6, 40, 400):
        got, want = [], []
        for _ in range(150):
            u = np.unique(g.integers(0, 2**64, n, dtype=np.uint64))
            a, b = np.sort(u[: int(n * 0.9)]), np.sort(u[int(n * 0.1) :])
            s = neardup.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            got.append((s[0] == s[1]).mean())
            want.append(len(np.intersect1d(a, b)) / len(u))
        assert abs(np.mean(got) - np.mean(want)) < 0.05


def test_words_of_rows_that_touch():
    rows = ["ab", "cd  ef", "", "\x0b", "gh\n"]
    data, offsets = wordvec.buffers(pa.array(rows))
    w = wordvec.words(data, offsets)
    assert np.diff(w.first).tolist() == [len(words(t)) for t in rows]
    h = wordvec.word_hashes(w)
    assert len(set(h.tolist())) == 4
