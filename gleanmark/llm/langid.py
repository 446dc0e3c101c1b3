"""Language identification: a linear-chain conditional random field over the words of a text.

Every word scores the languages by its byte n-grams, its affixes and a lexicon; learned transitions tie neighbouring
words, so that words in code-switched text are labelled in context. Forward-backward gives the marginals of all words
of the whole text. A document's language is the one with the largest sum of marginals, its score their mean.

Words are runs of letters (A-Z, a-z and bytes of other scripts), lower-cased in the latin range. Long texts run in
segments: transfer matrices of all segments are made side by side, then linked, which gives the exact marginals.

Training runs on the driver on a bounded sample (``rows`` texts, ``sample_bytes`` bytes, first by a hash of the id).
Sequences are put together from stretches of different texts, so that transitions between languages are seen.

Null texts and texts without a letter are ``und`` with score 0. Without labelled texts everything is ``und``.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from gleanmark.llm import arrays as A
from gleanmark.llm.frames import remainder

NGRAMS, AFFIXES, BITS, SEGMENT = (1, 2, 3), (2, 3, 4), 17, 128
UNDECIDED = "und"
DEALT = 64
_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


@dataclass
class Model:
    """Labels, feature weights (last row: no feature), lexicon hashes with their label, lexicon weights, transitions."""

    labels: list[str]
    weights: np.ndarray
    lexicon: np.ndarray
    lexicon_label: np.ndarray
    lexicon_weights: np.ndarray
    transitions: np.ndarray


def _lowered(data: np.ndarray) -> np.ndarray:
    """A-Z and the capitals U+00C0 to U+00DE in lower case."""
    out = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1
    out[capital] += np.uint8(32)
    return out


@dataclass
class WordFeatures:
    """Words of a piece laid side by side: where each starts, n-gram features per byte, affix features per word."""

    starts: np.ndarray
    grams: np.ndarray
    affixes: np.ndarray
    hashes: np.ndarray
    first: np.ndarray


def features(piece: A.Piece) -> WordFeatures:
    w = A.words(piece, _NOT_LETTER)
    sizes = w.ends - w.starts
    data = _lowered(piece.data)[~_NOT_LETTER[piece.data]] if len(piece.data) else piece.data
    ends = np.cumsum(sizes)
    starts = ends - sizes
    none = 1 << BITS
    room = np.repeat(ends, sizes) - np.arange(len(data))
    padded = np.concatenate([data, np.zeros(max(AFFIXES), np.uint8)]).astype(np.uint32)

    def code(at: np.ndarray | slice, n: int, salt: int) -> np.ndarray:
        value = np.full(len(data) if isinstance(at, slice) else len(at), salt, np.uint32)
        for j in range(n):
            part = padded[j : j + len(data)] if isinstance(at, slice) else padded[at + j]
            value = value * np.uint32(0x01000193) ^ part
        value = (value ^ (value >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        return (value >> np.uint32(32 - BITS)).astype(np.int32)

    grams = np.stack([np.where(room >= n, code(slice(None), n, n), none) for n in NGRAMS]) if len(data) else np.zeros(
        (len(NGRAMS), 0), np.int32)
    affixes = []
    for n in AFFIXES:
        fits = sizes >= n
        affixes.append(np.where(fits, code(starts, n, 16 + n), none))
        affixes.append(np.where(fits, code(np.maximum(ends - n, 0), n, 32 + n), none))
    hashes = A.span_hashes(data, starts, ends) if len(data) else np.zeros(0, np.uint64)
    return WordFeatures(starts, grams, np.stack(affixes), hashes, w.first)


def _in_lexicon(model: Model, hashes: np.ndarray) -> np.ndarray:
    """Label number in the lexicon, or the number of labels for words not in it."""
    if not len(model.lexicon):
        return np.full(len(hashes), len(model.labels))
    at = np.minimum(np.searchsorted(model.lexicon, hashes), len(model.lexicon) - 1)
    return np.where(model.lexicon[at] == hashes, model.lexicon_label[at], len(model.labels))


def emissions(model: Model, f: WordFeatures) -> np.ndarray:
    """Score of every label for every word."""
    if not len(f.starts):
        return np.zeros((0, len(model.labels)), np.float32)
    per_byte = model.weights[f.grams[0]]
    for g in f.grams[1:]:
        per_byte += model.weights[g]
    out = np.add.reduceat(per_byte, f.starts)
    for a in f.affixes:
        out += model.weights[a]
    return out + model.lexicon_weights[_in_lexicon(model, f.hashes)]


def marginals(emitted: np.ndarray, transitions: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Forward-backward marginals of the labels of all words; ``first``: index of each text's first word."""
    n, k = emitted.shape
    if not n:
        return emitted
    e = np.exp(emitted - emitted.max(axis=1, keepdims=True)) + np.float32(1e-20)
    a = np.exp(transitions - transitions.max()).astype(np.float32)
    sizes = np.diff(first)
    parts = -(-sizes // SEGMENT)
    text = np.repeat(np.arange(len(sizes)), parts)
    number = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = first[:-1][text] + number * SEGMENT
    length = np.minimum(SEGMENT, first[1:][text] - begin)
    order = np.argsort(-length, kind="stable")
    begin, length, text, number = begin[order], length[order], text[order], number[order]
    g = len(begin)
    active = np.searchsorted(-length, -np.arange(1, length.max() + 1), "right")

    transfer = np.tile(np.eye(k, dtype=np.float32), (g, 1, 1))
    for t, m in enumerate(active):
        part = (transfer[:m].reshape(-1, k) @ a).reshape(m, k, k) * e[begin[:m] + t][:, None, :]
        transfer[:m] = part / part.max(axis=(1, 2), keepdims=True)

    at = np.empty(g, np.int64)                       # segments by text and number
    at[np.lexsort((number, text))] = np.arange(g)
    back = np.argsort(at)
    firsts = np.cumsum(parts) - parts
    into, out_of = np.ones((g, k), np.float32), np.ones((g, k), np.float32)
    for j in range(1, int(parts.max())):
        seg = firsts[parts > j] + j
        v = np.einsum("gi,gij->gj", into[back[seg - 1]], transfer[back[seg - 1]])
        into[back[seg]] = v / v.max(axis=1, keepdims=True)
    for j in range(int(parts.max()) - 2, -1, -1):
        seg = firsts[parts > j + 1] + j
        v = np.einsum("gij,gj->gi", transfer[back[seg + 1]], out_of[back[seg + 1]])
        out_of[back[seg]] = v / v.max(axis=1, keepdims=True)

    result = np.empty((n, k), np.float32)
    state = into
    for t, m in enumerate(active):
        v = (state[:m] @ a) * e[begin[:m] + t]
        state[:m] = v / v.max(axis=1, keepdims=True)
        result[begin[:m] + t] = state[:m]
    state = out_of
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        result[begin[:m] + t] *= state[:m]
        v = (state[:m] * e[begin[:m] + t]) @ a.T
        state[:m] = v / v.max(axis=1, keepdims=True)
    return result / result.sum(axis=1, keepdims=True)


def _lexicon(hashes: np.ndarray, labels: np.ndarray, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``size`` frequent words per label that are mostly seen with it."""
    keys, back = np.unique(hashes, return_inverse=True)
    counts = np.bincount(back * k + labels, minlength=len(keys) * k).reshape(-1, k)
    best = counts.argmax(axis=1)
    top = counts[np.arange(len(keys)), best]
    sure = (top >= 5) & (top >= 0.8 * counts.sum(axis=1))
    kept = []
    for label in range(k):
        at = np.flatnonzero(sure & (best == label))
        kept.append(at[np.lexsort((keys[at], -top[at]))][:size])
    chosen = np.sort(np.concatenate(kept))
    return keys[chosen], best[chosen]


def train(texts: list[str], langs: list[str], steps: int = 220, batch: int = 48, length: int = 64, rate: float = 0.05,
          lexicon_size: int = 2000, seed: int = 11) -> Model:
    """Maximise the likelihood of the labels of word sequences with Adagrad."""
    labels = sorted(set(langs))
    k = len(labels)
    model = Model(labels, np.zeros(((1 << BITS) + 1, k), np.float32), np.zeros(0, np.uint64), np.zeros(0, np.int64),
                  np.zeros((k + 1, k), np.float32), np.eye(k, dtype=np.float32))
    if not texts:
        return model
    f = features(next(A.pieces(pa.array(texts, pa.large_string()), 1 << 62)))
    sizes = np.diff(f.first)
    y_of = np.repeat([labels.index(x) for x in langs], sizes)
    if not len(y_of):
        return model
    model.lexicon, model.lexicon_label = _lexicon(f.hashes, y_of, k, lexicon_size)
    known = _in_lexicon(model, f.hashes)
    rng = np.random.default_rng(seed)
    by_label = [np.flatnonzero(y_of == label) for label in range(k)]
    ends = np.append(f.starts[1:], f.grams.shape[1])
    sums = [np.full(w.shape, 1e-2, np.float32) for w in (model.weights, model.lexicon_weights, model.transitions)]
    for _ in range(steps):
        rows = []
        while len(rows) < batch * length:
            places = by_label[rng.integers(k)]
            if len(places):
                start = places[rng.integers(len(places))]
                stop = min(start + rng.integers(6, 49), f.first[np.searchsorted(f.first, start, "right")])
                rows.extend(range(start, stop))
        at = np.array(rows[: batch * length])
        y = y_of[at]
        n_bytes = ends[at] - f.starts[at]
        byte = np.repeat(f.starts[at] - np.cumsum(n_bytes) + n_bytes, n_bytes) + np.arange(n_bytes.sum())
        part = WordFeatures(np.cumsum(n_bytes) - n_bytes, f.grams[:, byte], f.affixes[:, at], f.hashes[at], f.first)
        emitted = emissions(model, part)
        p, pairs = _expected(emitted.reshape(batch, length, k), model.transitions)
        gold = np.eye(k, dtype=np.float32)[y].reshape(batch, length, k)
        d_emit = (p - gold).reshape(-1, k) / (batch * length)
        d_trans = (pairs - np.einsum("bti,btj->ij", gold[:, :-1], gold[:, 1:])) / (batch * length)
        d_weights = np.zeros_like(model.weights)
        word = np.repeat(np.arange(len(at)), n_bytes)
        for g in part.grams:
            np.add.at(d_weights, g, d_emit[word])
        for g in part.affixes:
            np.add.at(d_weights, g, d_emit)
        d_weights[-1] = 0
        d_lexicon = np.zeros_like(model.lexicon_weights)
        np.add.at(d_lexicon, known[at], d_emit)
        for w, d, s in zip((model.weights, model.lexicon_weights, model.transitions),
                           (d_weights, d_lexicon, d_trans), sums, strict=True):
            d = d * 30
            s += d * d
            w -= rate * d / np.sqrt(s)
    return model


def _expected(emitted: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (batch, length, label) and expected numbers of transitions, of sequences of equal length."""
    b, length, k = emitted.shape
    e = np.exp(emitted - emitted.max(axis=2, keepdims=True)) + np.float32(1e-20)
    a = np.exp(transitions - transitions.max())
    alpha, beta = np.empty_like(e), np.ones_like(e)
    v = np.ones((b, k), np.float32)
    for t in range(length):
        v = (v @ a) * e[:, t]
        v /= v.max(axis=1, keepdims=True)
        alpha[:, t] = v
    for t in range(length - 2, -1, -1):
        v = (beta[:, t + 1] * e[:, t + 1]) @ a.T
        beta[:, t] = v / v.max(axis=1, keepdims=True)
    p = alpha * beta
    p /= p.sum(axis=2, keepdims=True)
    pair = alpha[:, :-1, :, None] * a * (beta[:, 1:] * e[:, 1:])[:, :, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    return p, pair.sum(axis=(0, 1))


def labelled_sample(docs: DataFrame, rows: int = 1600, sample_bytes: int = 8 << 20) -> tuple[list[str], list[str]]:
    """Texts and languages to learn from; rows whose crc32(doc_id as text) mod 3 is 1 are held out.

    At most ``rows`` rows and ``sample_bytes`` bytes: the first row of every language by a hash of the id, then the second
    of every language, and so on. Texts that do not fit are skipped. Each language is first cut to some rows of each of
    ``DEALT`` parts, so that no task sorts all rows of a language.
    """
    known = (
        docs.where((remainder("doc_id", 3) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
        .groupBy("doc_id").agg(F.min("lang").alias("lang"), F.max(F.octet_length("text")).alias("size"))
        .where(F.col("size") <= sample_bytes)
        .select("doc_id", "lang", "size", F.md5(F.col("doc_id").cast("string")).alias("hash"),
                F.pmod(F.xxhash64("doc_id"), F.lit(DEALT)).alias("part"))
    )
    in_part = Window.partitionBy("lang", "part").orderBy("hash", "doc_id")
    of_language = Window.partitionBy("lang").orderBy("hash", "doc_id")
    given = (
        known.withColumn("nth", F.row_number().over(in_part)).where(F.col("nth") <= max(1, 4 * rows // DEALT))
        .withColumn("nth", F.row_number().over(of_language))
        .orderBy("nth", "hash", "doc_id").limit(rows).collect()
    )
    chosen, total = [], 0
    for r in given:
        if total + r["size"] > sample_bytes:
            continue
        total += r["size"]
        chosen.append(r["doc_id"])
    if not chosen:
        return [], []
    found = (
        docs.where(F.col("doc_id").isin(chosen) & F.col("lang").isNotNull() & F.col("text").isNotNull())
        .groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("x")).collect()
    )
    found.sort(key=lambda r: r["doc_id"])
    return [r["x"]["text"] for r in found], [r["x"]["lang"] for r in found]


def _has_letter(column: pa.Array, piece: A.Piece) -> np.ndarray:
    """Texts with a letter of any script."""
    found = A.per_text(_ASCII_LETTER[piece.data], piece.offsets) > 0
    for i in np.flatnonzero(~found & (np.diff(piece.offsets) > 0)):
        found[i] = any(c.isalpha() for c in column[piece.first + int(i)].as_py() or "")
    return found


def predict(model: Model):
    """Column function of a text: struct of ``lang`` and ``score``."""

    @arrow_udf("struct<lang:string,score:double>")
    def language(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            langs, scores = [], []
            for piece in A.pieces(column):
                f = features(piece)
                p = marginals(emissions(model, f), model.transitions, f.first) if model.labels else None
                lettered = _has_letter(column, piece)
                counts = np.diff(f.first)
                for i in range(piece.n):
                    if not lettered[i] or p is None:
                        langs.append(UNDECIDED)
                        scores.append(0.0)
                        continue
                    mean = p[f.first[i] : f.first[i + 1]].mean(axis=0, dtype=np.float64) if counts[i] else p
                    best = int(mean.argmax())
                    langs.append(model.labels[best])
                    scores.append(min(1.0, float(mean[best])))
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             ["lang", "score"])

    return language


def label_words(model: Model):
    """Column function of a text: its runs of words with the same likeliest label, in order."""

    @arrow_udf("array<struct<lang:string,first_word:bigint,n_words:bigint,score:double>>")
    def language_runs(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            out = []
            for piece in A.pieces(column):
                f = features(piece)
                p = marginals(emissions(model, f), model.transitions, f.first)
                for i in range(piece.n):
                    own = p[f.first[i] : f.first[i + 1]]
                    best = own.argmax(axis=1) if len(own) else np.zeros(0, int)
                    cuts = np.concatenate([[0], np.flatnonzero(np.diff(best)) + 1, [len(best)]])
                    out.append([
                        {"lang": model.labels[best[s]], "first_word": int(s), "n_words": int(e - s),
                         "score": float(own[s:e, best[s]].mean())}
                        for s, e in zip(cuts[:-1], cuts[1:], strict=True) if e > s
                    ])
            yield pa.array(out, pa.list_(pa.struct([
                ("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("score", pa.float64())])))

    return language_runs


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    return docs.select("doc_id", "text").select(
        "doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), predict(model)("text").alias("p")
    ).select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
