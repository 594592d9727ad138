import random
import zlib

import numpy as np
import pyarrow as pa

from docloom.llm import convnet, wordvec
from docloom.llm.queries import op10_quality_classifier
from tests.llm.helpers import documents, labels, prose

SMALL = "/root/testdata/sf0.01"


def test_held_out_accuracy_of_the_query(spark):
    out = op10_quality_classifier(spark, SMALL).collect()
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    assert len(out) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.doc_id in marks and r.held_out]
    assert sum(r.predicted == marks[r.doc_id] for r in held) >= 0.93 * len(held)
    good = [r.predicted for r in held if marks[r.doc_id]]
    assert sum(good) >= 0.96 * len(good)


def test_held_out_labels_are_not_learned(spark):
    g = random.Random(3)
    rows = [(i, prose(i, g.randint(5, 60)) if i % 4 else "$$$ ### " * g.randint(5, 40)) for i in range(120)]
    docs = documents(spark, rows)
    marks = [(i, int(i % 4 > 0), 0) for i, _ in rows]
    other = [(i, 1 - q, t) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, q, t) for i, q, t in marks]
    a, b = (convnet.trained(docs, labels(spark, x), epochs=1, least_steps=3) for x in (marks, other))
    assert all((x == y).all() for x, y in zip(a.parameters(), b.parameters()))


def test_awkward_rows(spark):
    docs = documents(spark)
    net = convnet.trained(docs, labels(spark, [(1, 1, 0), (1, 0, 0), (3, None, None), (None, 0, 0), (20, 1, 0), (4, 0, 0)]), epochs=2, least_steps=5)
    out = convnet.scored(docs, net)
    assert out.count() == docs.count() and out.where("not (score between 0 and 1) or predicted is null").count() == 0
    same = {r.score for r in out.where("row.doc_id = 60").collect()}
    assert len(same) == 1
    assert convnet.scored(documents(spark, []), convnet.trained(documents(spark, []), labels(spark, []))).count() == 0


def test_chunks_cover_the_whole_text():
    for n in (0, 1, 31, 32, 33, 255, 256, 257, 480, 481, 5000):
        data = (np.arange(n) % 250 + 1).astype(np.uint8)
        k = int(convnet.n_chunks(np.array([n]))[0])
        starts = np.arange(k) * convnet.STEP
        assert k >= 1 and starts[-1] + convnet.CHUNK >= n
        out = convnet.chunks(data, starts, np.full(k, n))
        covered = np.zeros(n, bool)
        for a, row in zip(starts, out):
            own = data[a : a + convnet.CHUNK]
            assert (row[: len(own)] == own).all() and not row[len(own) :].any()
            covered[a : a + convnet.CHUNK] = True
        assert covered.all()


def test_training_texts_have_all_their_chunks():
    text = bytes((k // 7) % 250 + 1 for k in range(40 * convnet.STEP))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([text, b""]), pa.array([1, 0], pa.int32())], names=["_id", "text", "label"])
    cut = next(convnet._cut(iter([batch]))).column(1).to_pylist()
    n = int(convnet.n_chunks(np.array([len(text)]))[0])
    assert n > 12 and len(cut[0]) == n * convnet.CHUNK and len(cut[1]) == convnet.CHUNK
    assert all(cut[0][k * convnet.CHUNK : (k + 1) * convnet.CHUNK].rstrip(b"\0") == text[k * convnet.STEP :][: convnet.CHUNK] for k in range(n))


def test_scores_do_not_depend_on_other_rows(spark):
    net = convnet.Network.new(2)
    rows = [(k, prose(k % 37, 5 + 40 * (k % 7))) for k in range(150)] + [(999, prose(1, 30000)), (1000, ""), (1001, None)]
    docs = documents(spark, rows)
    first = {r.row.doc_id: r.score for r in convnet.scored(docs.coalesce(1), net).collect()}
    for n in (3, 7):
        assert {r.row.doc_id: r.score for r in convnet.scored(docs.repartition(n), net).collect()} == first
    for k, text in rows[::29] + rows[-3:]:
        data, offsets = wordvec.buffers(pa.array([text], pa.string()))
        assert convnet.probabilities(net, data, offsets)[0] == first[k]
    assert all(first[a] == first[b] for (a, x), (b, y) in zip(rows, rows[1:]) if x == y) and first[1000] == first[1001]


def test_pooling_equals_a_plain_convolution():
    net = convnet.Network.new(1)
    text = prose(1, 400).encode() + b"\xff\x00end"
    data, offsets = wordvec.buffers(pa.array([text, b"", b"short"]))
    got = convnet.probabilities(net, data, offsets)
    for k, t in enumerate([text, b"", b"short"]):
        starts = range(0, max(1, int(convnet.n_chunks(np.array([len(t)]))[0])) * convnet.STEP, convnet.STEP)
        features = []
        for a in starts:
            chunk = t[a : a + convnet.CHUNK].ljust(convnet.CHUNK, b"\0")
            best = np.full(convnet.FILTERS, -np.inf)
            for p in range(0, convnet.CHUNK - convnet.WIDTH + 1, convnet.STRIDE):
                window = net.bytes_[list(chunk[p : p + convnet.WIDTH])].reshape(-1)
                best = np.maximum(best, window @ net.filters)
            features.append(np.maximum(best + net.bias, 0))
        f = np.array(features)
        z = float((f.mean(0) @ net.mean + f.max(0) @ net.max_ + net.offset)[0])
        assert abs(got[k] - 1 / (1 + np.exp(-z))) < 5e-3  # the filters' weights are rounded to 127 steps


def test_rounded_sums_are_exact():
    """The rounded network against whole-number arithmetic, to the last bit."""
    net = convnet.Rounded.of(convnet.Network.new(3))
    for text in (prose(2, 300).encode(), b"", b"\xff" * 700):
        data, offsets = wordvec.buffers(pa.array([text]))
        k = int(convnet.n_chunks(np.array([len(text)]))[0])
        bytes_, filters = net.bytes_.astype(np.int64), net.filters.astype(np.int64)
        found = []
        for a in range(k):
            chunk = text[a * convnet.STEP :][: convnet.CHUNK].ljust(convnet.CHUNK, b"\0")
            places = range(0, convnet.CHUNK - convnet.WIDTH + 1, convnet.STRIDE)
            found.append(np.max([bytes_[list(chunk[p : p + convnet.WIDTH])].reshape(-1) @ filters for p in places], 0))
        found = np.maximum(np.array(found) + net.bias, 0)
        z = net.offset
        for f in range(convnet.FILTERS):
            z = z + found[:, f].sum() / k * net.mean[f] + found[:, f].max() * net.max_[f]
        assert net.probabilities(data, offsets)[0] == 1 / (1 + np.exp(-z))


def test_gradients_lower_the_loss():
    g = np.random.default_rng(1)
    texts, y = [], []
    for k in range(80):
        raw = g.integers(97, 123, (2, convnet.CHUNK)).astype(np.uint8)
        if k % 2:
            raw[:, 40:48] = np.frombuffer(b"BADWORDS", np.uint8)
        texts.append(raw)
        y.append(1 - k % 2)
    net = convnet.fit(texts, np.array(y, np.float32), np.ones(80, np.float32), epochs=100, least_steps=1)
    p = [convnet.probabilities(net, t[0], np.array([0, convnet.CHUNK]))[0] for t in texts]
    assert np.mean((np.array(p) > 0.5) == np.array(y)) > 0.95
