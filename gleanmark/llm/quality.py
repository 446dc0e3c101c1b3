"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters read five bytes at every second position of the whole text. Their outputs are averaged over
overlapping chunks, a second layer of learned filters reads the chunks, each of these filters keeps its maximum over
all chunks, and a logistic unit combines the maxima into one probability. Training and scoring use the same forward
pass; neither cuts a text.

The network is fitted in one task from a bounded sample of labelled rows: at most ``rows`` texts of together at
most ``sample_bytes`` bytes, chosen by a hash of the id. Scoring runs in the executors on Arrow batches.

Null and empty texts have one chunk of zero bytes and get its score. Repeated rows are scored each for itself.
"""
from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from gleanmark.llm.arrays import Piece, pieces
from gleanmark.llm.frames import remainder

WIDTH, STRIDE, EMBED, FILTERS, HIDDEN = 5, 2, 6, 16, 24
HALF = 32                      # filter positions in half a chunk; chunks overlap by half
SPAN = HALF * STRIDE           # bytes that half a chunk moves on


@dataclass
class Network:
    """Weights. ``embed`` 256 x EMBED, ``w1`` (WIDTH * EMBED) x FILTERS, ``w2`` FILTERS x HIDDEN, ``w3`` HIDDEN."""

    embed: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    w3: np.ndarray
    b3: np.ndarray

    @classmethod
    def start(cls, seed: int) -> Network:
        rng = np.random.default_rng(seed)

        def normal(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        return cls(
            normal(256, EMBED, scale=0.5), normal(WIDTH * EMBED, FILTERS, scale=(2 / (WIDTH * EMBED)) ** 0.5),
            np.zeros(FILTERS, np.float32), normal(FILTERS, HIDDEN, scale=(2 / FILTERS) ** 0.5),
            np.zeros(HIDDEN, np.float32), normal(HIDDEN, scale=HIDDEN ** -0.5), np.zeros(1, np.float32),
        )

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.w1, self.b1, self.w2, self.b2, self.w3, self.b3]

    def tables(self) -> np.ndarray:
        """What each byte adds to each filter at each place of the window."""
        return np.stack([self.embed @ self.w1[k * EMBED : (k + 1) * EMBED] for k in range(WIDTH)])


def _laid_out(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Texts padded with zero bytes to whole half chunks, at least two each; and the half chunks of each text.

    A text starts with some zero bytes, so that the last window of the one before reads nothing of it.
    """
    sizes = np.diff(piece.offsets)
    halves = np.maximum(2, -(-(sizes + WIDTH) // SPAN))
    begins = np.concatenate([[0], np.cumsum(halves)]) * SPAN
    data = np.zeros(begins[-1] + WIDTH, np.uint8)
    shift = np.repeat(begins[:-1] + WIDTH - piece.offsets[:-1], sizes)
    data[np.arange(len(piece.data)) + shift] = piece.data
    return data, halves


def _half_means(net: Network, tables: np.ndarray, data: np.ndarray, n_halves: int) -> np.ndarray:
    """Mean output of the first layer over every half chunk, some thousand at a time."""
    out = np.empty((n_halves, FILTERS), np.float32)
    step = 512
    for first in range(0, n_halves, step):
        n = min(step, n_halves - first)
        part = data[first * SPAN : (first + n) * SPAN + WIDTH]
        z = tables[0][part[0 : n * SPAN : STRIDE]]
        for k in range(1, WIDTH):
            z += tables[k][part[k : k + n * SPAN : STRIDE]]
        z += net.b1
        np.maximum(z, 0, out=z)
        out[first : first + n] = z.reshape(n, HALF, FILTERS).mean(axis=1)
    return out


def _chunks(means: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunk means, the half chunk each begins with, and the first chunk of each text."""
    last = np.cumsum(halves) - 1
    begins = np.delete(np.arange(len(means)), last)
    return (means[begins] + means[begins + 1]) / 2, begins, np.concatenate([[0], np.cumsum(halves - 1)[:-1]])


def _sigmoid(logits: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logits.astype(np.float64), -60, 60)))


def forward(net: Network, tables: np.ndarray, piece: Piece) -> np.ndarray:
    """Probability of label 1 for every text of a piece."""
    data, halves = _laid_out(piece)
    chunks, _begins, first = _chunks(_half_means(net, tables, data, int(halves.sum())), halves)
    hidden = np.maximum(chunks @ net.w2 + net.b2, 0)
    pooled = np.maximum.reduceat(hidden, first)
    return _sigmoid(pooled @ net.w3 + net.b3[0])


def _gradients(net: Network, piece: Piece, labels: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """Gradients of the weighted log loss; only chunks that hold a maximum take part in the way back."""
    data, halves = _laid_out(piece)
    chunks, begins, first = _chunks(_half_means(net, net.tables(), data, int(halves.sum())), halves)
    hidden = np.maximum(chunks @ net.w2 + net.b2, 0)
    text_of = np.repeat(np.arange(piece.n), halves - 1)
    pooled = np.maximum.reduceat(hidden, first)
    best = np.empty((piece.n, HIDDEN), np.int64)
    for h in range(HIDDEN):
        order = np.lexsort((np.arange(len(hidden)), -hidden[:, h], text_of))
        best[:, h] = order[first]
    p = _sigmoid(pooled @ net.w3 + net.b3[0])
    d_logit = ((p - labels) * weights).astype(np.float32)
    d_hidden = d_logit[:, None] * net.w3 * (pooled > 0)
    used, at = np.unique(best, return_inverse=True)
    d_z2 = np.zeros((len(used), HIDDEN), np.float32)
    np.add.at(d_z2, (at.reshape(best.shape), np.arange(HIDDEN)[None, :]), d_hidden)
    d_chunk = d_z2 @ net.w2.T / (2 * HALF)
    where = (begins[used] * SPAN)[:, None, None] + (np.arange(2 * HALF) * STRIDE)[:, None] + np.arange(WIDTH)
    seen = data[where]
    x = net.embed[seen].reshape(len(used) * 2 * HALF, WIDTH * EMBED)
    z1 = x @ net.w1 + net.b1
    d_z1 = np.repeat(d_chunk, 2 * HALF, axis=0) * (z1 > 0)
    d_x = (d_z1 @ net.w1.T).reshape(-1, EMBED)
    flat = seen.ravel()
    d_embed = np.stack([np.bincount(flat, d_x[:, e], 256) for e in range(EMBED)], axis=1)
    return [
        d_embed.astype(np.float32), x.T @ d_z1, d_z1.sum(0), chunks[used].T @ d_z2, d_z2.sum(0),
        pooled.T @ d_logit, np.array([d_logit.sum()]),
    ]


def train(texts: list[str], labels: list[int], steps: int = 480, batch: int = 64, rate: float = 0.01,
          seed: int = 7) -> Network:
    """Fit the network with ``steps`` of Adam, a small sample being gone through more often.

    Both labels weigh the same in total, then the bias is set back to their real odds.
    """
    net = Network.start(seed)
    y = np.asarray(labels, np.float32)
    if not len(y):
        return net
    share = y.mean()
    if share in (0.0, 1.0):
        net.w3[:], net.b3[:] = 0, 4.0 if share else -4.0
        return net
    weights = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    rng = np.random.default_rng(seed)
    first = [np.zeros_like(w) for w in net.weights()]
    second = [np.zeros_like(w) for w in net.weights()]
    done, per_epoch = 0, -(-len(y) // batch)
    epochs = -(-steps // per_epoch)
    total = epochs * per_epoch
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for begin in range(0, len(y), batch):
            rows = order[begin : begin + batch]
            column = pa.array([texts[i] for i in rows], pa.large_string())
            (piece,) = pieces(column, 1 << 62)
            done += 1
            pace = rate * (1 - (done - 1) / total)
            for w, g, m, v in zip(net.weights(), _gradients(net, piece, y[rows], weights[rows] / len(rows)),
                                  first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= pace * (m / (1 - 0.9 ** done)) / (np.sqrt(v / (1 - 0.999 ** done)) + 1e-7)
    net.b3 += np.float32(np.log(share / (1 - share)))
    return net


def _chosen(docs: DataFrame, labels: DataFrame, rows: int, sample_bytes: int, label: str) -> dict[object, int]:
    """Ids of the texts to learn from, in order, and their labels."""
    given = (
        labels.where((remainder("doc_id", 5) != 0) & F.col(label).isNotNull())
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(rows).collect()
    )
    rank = {r["doc_id"]: i for i, r in enumerate(given)}
    if not rank:
        return {}
    wanted = docs.where(F.col("doc_id").isin(list(rank)) & F.col("text").isNotNull())
    sizes = wanted.groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("size")).collect()
    chosen, total = {}, 0
    for r in sorted(sizes, key=lambda r: rank[r["doc_id"]]):
        if total + r["size"] > sample_bytes:
            continue
        total += r["size"]
        chosen[r["doc_id"]] = given[rank[r["doc_id"]]]["y"]
    return chosen


def _texts(docs: DataFrame, chosen: dict[object, int]) -> DataFrame:
    return docs.where(F.col("doc_id").isin(list(chosen))).groupBy("doc_id").agg(F.max("text").alias("text"))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = 2500, sample_bytes: int = 24 << 20,
                    label: str = "quality") -> tuple[list[str], list[int]]:
    """Texts and labels to learn from: at most ``rows`` rows and ``sample_bytes`` bytes, first by a hash of the id.

    A text that does not fit is skipped. Rows whose crc32(doc_id as text) mod 5 is 0 are held out; nulls in id, text or
    label are left out. Of a document with several labels the largest counts, of several texts of an id the last.
    """
    chosen = _chosen(docs, labels, rows, sample_bytes, label)
    if not chosen:
        return [], []
    texts = dict(_texts(docs, chosen).collect())
    return [texts[i] for i in chosen], list(chosen.values())


def trained(docs: DataFrame, labels: DataFrame, rows: int = 2500, sample_bytes: int = 24 << 20,
            label: str = "quality") -> Network:
    """The network fitted to ``labelled_sample``, in one task: the driver holds ids and weights, no texts."""
    chosen = _chosen(docs, labels, rows, sample_bytes, label)
    if not chosen:
        return train([], [])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict = {}
        for batch in batches:
            texts.update(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        if texts:
            net = train([texts[i] for i in chosen], list(chosen.values()))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], ["net"])

    return pickle.loads(_texts(docs, chosen).repartition(1).mapInArrow(fit, "net binary").first()["net"])


def score(net: Network) -> Column:
    """Column function of one text column: probability of label 1."""
    tables = net.tables()

    @arrow_udf("double")
    def quality_score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            parts = [forward(net, tables, piece) for piece in pieces(column)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return quality_score


def scored(docs: DataFrame, net: Network, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; held_out is null where the id is null."""
    return (
        docs.select("doc_id", "text")
        .select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), score(net)("text").alias("score"))
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )
