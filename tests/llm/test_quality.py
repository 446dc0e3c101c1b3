import hashlib
import zlib

import numpy as np
import pyarrow as pa

from gleanmark.llm import quality
from gleanmark.llm.arrays import pieces

SMALL = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    texts, y = quality.labelled_sample(docs, labels)
    assert len(texts) == len(y) > 200
    rows = quality.scored(docs, quality.train(texts, y)).join(labels, "doc_id").where("held_out").collect()
    right = np.mean([r["predicted"] == r["quality"] for r in rows])
    kept = np.mean([r["predicted"] for r in rows if r["quality"] == 1])
    assert right > 0.9 and kept > 0.97


def test_gradients():
    net = quality.Network.start(3)
    (piece,) = pieces(pa.array(["abc " * 40, "XYZ!! " * 50, "short"]), 1 << 30)
    y, w = np.array([1, 0, 1], np.float32), np.ones(3, np.float32)

    def loss():
        p = quality.forward(net, net.tables(), piece)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()

    for weights, gradient in zip(net.weights(), quality._gradients(net, piece, y, w), strict=True):
        i = np.unravel_index(np.abs(gradient).argmax(), gradient.shape)
        was, step = weights[i], 2e-3
        weights[i] = was + step
        up = loss()
        weights[i] = was - step
        down = loss()
        weights[i] = was
        assert abs((up - down) / (2 * step) - gradient[i]) < 0.08 * abs(gradient[i]) + 2e-3


def test_whole_text_counts(spark):
    good, bad = [f"good words here {i} " * (i % 40 + 1) for i in range(90)], [f"good {i} " * i + "BAD!! " * 20 for i in range(90)]
    net = quality.train(good + bad, [1] * 90 + [0] * 90, steps=120)
    (piece,) = pieces(pa.array(["good words here " * 500, "good words here " * 500 + "BAD!! " * 60]), 1 << 30)
    first, second = quality.forward(net, net.tables(), piece)
    assert first > 0.5 > second


def test_neighbours_do_not_matter():
    net = quality.Network.start(1)
    texts = ["", "a", "x" * 59, "y" * 60, "z" * 64, "w" * 200, "", "v" * 127]
    (together,) = pieces(pa.array(texts), 1 << 30)
    alone = [quality.forward(net, net.tables(), next(pieces(pa.array([t]))))[0] for t in texts]
    assert np.allclose(quality.forward(net, net.tables(), together), alone, atol=1e-6)


def test_odd_rows(odd_documents, no_documents, spark):
    net = quality.train([], [])
    found = quality.scored(odd_documents, net).collect()
    assert len(found) == odd_documents.count()
    assert all(0 <= r["score"] <= 1 for r in found)
    assert sum(r["held_out"] is None for r in found) == 2
    same = {r["score"] for r in found if r["doc_id"] in (4, 5)}
    assert len(same) == 1
    assert quality.scored(no_documents, net).count() == 0
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality.labelled_sample(odd_documents, labels) == ([], [])


def test_sample_skips_long_texts(spark):
    ids = sorted((i for i in range(60) if zlib.crc32(str(i).encode()) % 5), key=lambda i: hashlib.md5(str(i).encode()).digest())
    docs = spark.createDataFrame([(i, "long " * 1000 if i == ids[0] else f"text {i}") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    texts, y = quality.labelled_sample(docs, labels, sample_bytes=2000)
    assert texts == [f"text {i}" for i in ids[1:]] and y == [i % 2 for i in ids[1:]]
