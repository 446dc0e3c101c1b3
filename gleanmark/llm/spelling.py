"""Spelling variants by reduced-alphabet generation.

Letters are hashed to a few symbols, which turns every word of the vocabulary into a reduced word. The full one-edit
neighbourhood of a reduced word, in the reduced alphabet and with the reduced word itself, is small and does not depend
on the real alphabet; joined with the reduced words of the vocabulary it finds every word that one inserted, deleted or
replaced code point apart can lead to. Candidates are verified on the original words.

Reduced words travel as 64-bit hashes that are made for all neighbours from the prefix sums of one word, so a word of
any length costs a number per neighbour and no string. Equal hashes of different reduced words only give candidates that
the verification refuses. The number of symbols grows with the sixth root of the vocabulary, so that a reduced word of
six symbols stands for a bounded number of words on average; it steers costs only.

A word's form is its near word with the largest count, if that is ``factor`` times its own at least; counts grow along
forms, so chains of forms are short and end in a root, found by pointer jumping.

Null and empty texts have no words. A null id counts as an empty one. Repeated rows and copies count as often as they
stand in the table. Words of any length are treated alike.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanmark.llm import arrays as A
from gleanmark.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_SYMBOLS = 4
LETTERS_A_WORD = 6
BATCH_KEYS = 1 << 18

_BASE = 0xD1342543DE82EF95
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))
_B = np.uint64(_BASE)


def words(docs: DataFrame, drop_in: int = 199) -> DataFrame:
    """word: every run of latin letters in the texts of ``docs`` (doc_id, text), in lower case (A-Z only).

    Where ``drop_in`` divides the crc32 of ``<doc_id>:<run>``, the run loses the letter at that number modulo its length.
    """
    lower = F.translate("text", UPPER, LOWER)
    run = F.explode(F.regexp_extract_all(lower, F.lit("[a-zÀ-ÿ]+"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.withColumn("h", h).select(F.when(F.col("h") % drop_in == 0, short).otherwise(F.col("run")).alias("word"))


def vocabulary(found: DataFrame, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """word, n and id (a hash) of the words (``word``) of enough code points that occur often enough; written once."""
    counts = found.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return materialize(counts.where(F.col("n") >= least_count).withColumn("id", F.xxhash64("word")), "spelling-words")


def symbols_for(n_words: int) -> int:
    return max(LEAST_SYMBOLS, math.ceil(n_words ** (1 / LETTERS_A_WORD)))


def _powers(n: int) -> np.ndarray:
    steps = np.full(n + 2, _B, np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


def _sums(codes: np.ndarray, power: np.ndarray) -> np.ndarray:
    """Prefix sums of the symbols of a reduced word, each times the power of its place."""
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes + np.uint64(1)) * power[: len(codes)], out=sums[1:])
    return sums


def _key(total: np.ndarray, length: int) -> np.ndarray:
    return A.mix(total * np.uint64(3) + np.uint64(length)).view(np.int64)


def reduced(word: str, symbols: int) -> np.ndarray:
    """The symbol numbers of a word."""
    return np.frombuffer(word.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64) % np.uint64(symbols)


def own_key(codes: np.ndarray, power: np.ndarray) -> np.ndarray:
    return _key(_sums(codes, power)[-1:], len(codes))


def neighbour_keys(codes: np.ndarray, symbols: int, power: np.ndarray) -> Iterator[np.ndarray]:
    """Keys of the reduced word and of its one-edit neighbours, each neighbour once, some thousands at a time.

    In a run of equal symbols only the last is deleted, and a symbol is not inserted after an equal one, as these give
    the same words.
    """
    n, sums = len(codes), _sums(codes, power)
    total = sums[-1]
    yield _key(sums[-1:], n)
    step = max(1, BATCH_KEYS // symbols)
    letters = np.arange(symbols, dtype=np.uint64)
    for low in range(0, n + 1, step):
        high = min(n, low + step)
        own = codes[low:high]
        last = np.ones(high - low, bool)
        if high > low:
            last[:-1] = own[1:] != own[:-1]
            last[-1] = high == n or codes[high] != own[-1]
        gone = sums[low:high] + (total - sums[low + 1 : high + 1]) * _BACK
        yield _key(gone[last], n - 1)
        change = (letters[None, :] - own[:, None]) * power[low:high, None]
        yield _key((total + change)[letters[None, :] != own[:, None]], n)
        places = np.arange(low, min(n + 1, low + step))
        before = np.where(places > 0, codes[np.maximum(places - 1, 0)] if n else 0, symbols).astype(np.uint64)
        put = (letters[None, :] + np.uint64(1)) * power[places, None]
        grown = sums[places][:, None] + put + ((total - sums[places]) * _B)[:, None]
        yield _key(grown[letters[None, :] != before[:, None]], n + 1)


def _keyed(vocab: DataFrame, symbols: int, neighbours: bool) -> DataFrame:
    """key, id: of the reduced words, or of their whole neighbourhoods."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = _powers(64)
        for batch in batches:
            keys, ids, held = [], [], 0
            for word, id_ in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                codes = reduced(word.as_py(), symbols)
                if len(codes) + 2 > len(power):
                    power = _powers(2 * len(codes))
                for part in neighbour_keys(codes, symbols, power) if neighbours else [own_key(codes, power)]:
                    keys.append(part)
                    ids.append(np.full(len(part), id_, np.int64))
                    held += len(part)
                    if held >= BATCH_KEYS:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(ids))], ["key", "id"])
                        keys, ids, held = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(ids))], ["key", "id"])

    return vocab.select("word", "id").mapInArrow(emit, "key bigint, id bigint")


def near_words(vocab: DataFrame, symbols: int | None = None) -> DataFrame:
    """id, word, n and near_id, near, near_n of all pairs of words one edit apart, in both directions.

    ``vocab``: a written table (word, n, id) of distinct words.
    """
    symbols = symbols or symbols_for(vocab.count())
    around = _keyed(vocab, symbols, True)
    at = _keyed(vocab, symbols, False).toDF("at_key", "near_id")
    candidates = around.join(at, (F.col("key") == F.col("at_key")) & (F.col("id") != F.col("near_id"))).select("id", "near_id")
    left = candidates.join(vocab.select("id", "word", "n"), "id")
    right = vocab.select(F.col("id").alias("near_id"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return left.join(right, "near_id").where(F.levenshtein("word", "near", 1) == 1).dropDuplicates(["id", "near_id"])


def roots(forms: DataFrame, longest: int) -> DataFrame:
    """id, root_id of every row of ``forms`` (id, form_id), whose chains have at most ``longest`` links."""
    at = forms.select("id", F.col("form_id").alias("root_id"))
    for _ in range(max(0, math.ceil(math.log2(max(1, longest))))):
        at = materialize(at, "spelling-roots")
        further = at.toDF("next", "next_root")
        at = at.join(further, F.col("root_id") == F.col("next"), "left").select(
            "id", F.coalesce("next_root", "root_id").alias("root_id"))
    return at


def grouped(vocab: DataFrame, factor: int = 5, symbols: int | None = None) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of ``vocab`` (a written table: word, n, id).

    Ties of the largest count go to the smallest word in code-point order.
    """
    best = F.min(F.struct((-F.col("near_n")).alias("order"), "near", F.col("near_id").alias("form_id")))
    found = materialize(
        near_words(vocab, symbols).groupBy("id").agg(F.count("*").alias("n_near"), best.alias("b"))
        .select(F.col("id").alias("of"), "n_near", F.col("b.near").alias("form"), (-F.col("b.order")).alias("form_n"), "b.form_id"),
        "spelling-near",
    )
    strong = F.col("form_n") >= factor * F.col("n")
    known = vocab.join(found, F.col("id") == F.col("of"), "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        *[F.when(strong, F.col(c)).alias(c) for c in ("form", "form_n", "form_id")])
    known = materialize(known, "spelling-forms")
    low, high = vocab.agg(F.min("n"), F.max("n")).first()
    longest = 1 + int(math.log(high / low, factor) + 1e-9) if high else 0
    ends = roots(known.where("form_id IS NOT NULL"), longest).select(F.col("id").alias("end_of"), "root_id")
    names = vocab.select(F.col("id").alias("name_id"), F.col("word").alias("name"))
    ended = ends.join(names, F.col("root_id") == F.col("name_id")).select("end_of", "name")
    return known.join(ended, F.col("id") == F.col("end_of"), "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("name", "word").alias("root"))


def spelling_variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, factor: int = 5,
                      drop_in: int = 199) -> DataFrame:
    """``grouped`` over the words of ``docs`` (doc_id, text)."""
    return grouped(vocabulary(words(docs, drop_in), least_length, least_count), factor)
