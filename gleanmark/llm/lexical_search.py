"""Ranked lexical search: accumulator-limited term-at-a-time scoring.

All documents are read once and written as an index: for every document its length and, for the terms that the items
use, how often each occurs. Counts over the index give the terms' weights. Then each task scores its documents for all
items, in blocks of bounded size that it inverts by term.

For an item the terms of a block come rarest first. They create accumulators as long as an unseen document could still
reach the k-th best score known, which is the k-th partial score of the block or the k-th score of the task's earlier
blocks, whichever is higher; the bound is what the remaining terms add at most in this block. After that no accumulator
is created, those that the bound rules out go, and the remaining terms update the survivors by look-up, exactly. A task
returns its k best documents for every item, and the best of all tasks follow from these.

Items are taken in blocks with a bounded number of terms, which is what tasks hold in memory. Scores are integers:
weights from logarithms, all else by integer division. Terms are known by 64-bit hashes.

Null, empty and term-less texts are no documents: they count nowhere and are never found. Equal scores rank by ascending
id, null ids last; repeated rows are documents of their own. Items with the same id and text are one item; an item
without terms finds nothing.
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
from gleanmark.plans.ranks import running_total
from gleanmark.session import materialize

#: Terms of all items of a block, and postings and documents of an inverted block in a task.
BLOCK_TERMS = 1 << 20
BLOCK_POSTINGS, BLOCK_DOCUMENTS = 1 << 21, 1 << 13

_OUTSIDE = np.ones(256, bool)
_OUTSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def term_counts(text: str, wanted: np.ndarray | None = None) -> Column:
    """Struct of ``n`` (terms with repeats), ``terms`` and ``tf`` of a text column.

    ``terms`` are hashes or, with ``wanted`` (a broadcast of sorted hashes), places in ``wanted``, and only those.
    """

    @arrow_udf("struct<n:bigint,terms:array<bigint>,tf:array<bigint>>")
    def counted(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = None if wanted is None else wanted.value
        for column in columns:
            n, terms, tf, sizes = ([np.zeros(0, np.int64)] for _ in range(4))
            for piece in A.pieces(column):
                w = A.words(piece, _OUTSIDE)
                hashes = A.span_hashes(piece.data, w.starts, w.ends, lower=True).view(np.int64)
                n.append(np.diff(w.first))
                text_of = w.text_of
                if known is not None:
                    at = np.searchsorted(known, hashes)
                    at[at == len(known)] = 0
                    held = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
                    hashes, text_of = at[held], text_of[held]
                order = np.lexsort((hashes, text_of))
                hashes, text_of = hashes[order], text_of[order]
                new = np.ones(len(hashes), bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (text_of[1:] != text_of[:-1])
                first = np.flatnonzero(new)
                terms.append(hashes[first])
                tf.append(np.diff(np.append(first, len(hashes))))
                sizes.append(np.bincount(text_of[first], minlength=piece.n))
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(np.int64))) for x in (terms, tf)]
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(n).astype(np.int64)), *lists], ["n", "terms", "tf"])

    return counted(text)


def numbered_items(items: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item, item_id, terms, repeats and block of every distinct item with a term; written once."""
    rows = items.select("item_id", F.col("text").alias("item_text")).distinct()
    rows = rows.select("item_id", F.xxhash64("item_id", "item_text").alias("item"), term_counts("item_text").alias("t"))
    filled = rows.where("t.n > 0").select("item_id", "item", F.col("t.terms").alias("terms"), F.col("t.tf").alias("repeats"))
    upto = running_total(filled, [], "item", "upto", F.size("terms"))
    return materialize(upto.withColumn("block", F.floor((F.col("upto") - 1) / block_terms)).drop("upto"), "search-items")


@dataclass(frozen=True)
class Items:
    """Items of a block: their hashes, and for each its terms, rarest first, with weight times repeats."""

    item: np.ndarray
    terms: list[np.ndarray]
    weights: list[np.ndarray]


class _Block:
    """Some documents of a task, inverted by term."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tf: np.ndarray,
                 n_docs: int, total: int) -> None:
        self.ids = ids
        owner = np.repeat(np.arange(len(n)), sizes)
        m = 25 + (75 * n * n_docs) // total
        gain = (1_000_000_000 * tf) // (1000 * tf + 8 * m[owner])
        order = np.argsort(terms, kind="stable")
        self.owner, self.gain = owner[order], gain[order]
        self.terms, self.first = np.unique(terms[order], return_index=True)
        self.last = np.append(self.first[1:], len(order))
        self.most = np.maximum.reduceat(self.gain, self.first) if len(order) else self.gain
        self.scores = np.zeros(len(n), np.int64)

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents with scores that may be among the ``k`` best, none below ``floor``, of an item's terms."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
        here = (self.terms[at] == terms) if len(self.terms) else np.zeros(len(terms), bool)
        at, weights = at[here], weights[here]
        rest = np.append(np.cumsum((weights * self.most[at])[::-1])[::-1], 0)
        scores, reach, j = self.scores, max(floor, 1), 0
        while j < len(at) and rest[j] >= reach:
            part = slice(self.first[at[j]], self.last[at[j]])
            scores[self.owner[part]] += weights[j] * self.gain[part]
            j += 1
            if rest[j] > 0 and len(scores) >= k:
                reach = max(reach, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
        found = np.flatnonzero(scores)
        kept = scores[found]
        scores[found] = 0
        for i in range(j, len(at)):
            able = kept + rest[i] >= reach
            found, kept = found[able], kept[able]
            if not len(found):
                break
            low, high = self.first[at[i]], self.last[at[i]]
            place = np.minimum(low + np.searchsorted(self.owner[low:high], found), high - 1)
            kept = kept + np.where(self.owner[place] == found, weights[i] * self.gain[place], 0)
        able = kept >= reach
        return found[able], kept[able]


def _ordered(scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places by falling score, then by id, unknown ids last."""
    return np.lexsort((ids, ~known, -scores))


def _scorer(items, n_docs: int, total: int, k: int):
    """mapInArrow function: index rows (doc_id, n, terms, tf) to the task's ``k`` best of every item."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Items = items.value
        n_items = len(asked.item)
        best: list[tuple] = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)] * n_items
        held, postings = [], 0

        def flush() -> None:
            ids, known, n, sizes, terms, tf = (np.concatenate(x) for x in zip(*held, strict=True))
            block = _Block(ids, n, sizes, terms, tf, n_docs, total)
            for i in range(n_items):
                old_scores, old_ids, old_known = best[i]
                floor = int(old_scores[-1]) if len(old_scores) == k else 1
                found, scores = block.best(asked.terms[i], asked.weights[i], k, floor)
                if len(found):
                    scores, ids_, known_ = (np.concatenate(x) for x in (
                        (old_scores, scores), (old_ids, ids[found]), (old_known, known[found])))
                    order = _ordered(scores, ids_, known_)[:k]
                    best[i] = scores[order], ids_[order], known_[order]

        for batch in batches:
            id_, n, terms, tf = (batch.column(i) for i in range(4))
            known = id_.is_valid().to_numpy(zero_copy_only=False)
            sizes = np.diff(terms.offsets.to_numpy())
            held.append((id_.fill_null(0).to_numpy(), known, n.to_numpy(), sizes,
                         terms.flatten().to_numpy(), tf.flatten().to_numpy()))
            postings += len(held[-1][4])
            if postings >= BLOCK_POSTINGS or sum(len(h[0]) for h in held) >= BLOCK_DOCUMENTS:
                flush()
                held, postings = [], 0
        if held:
            flush()
        for i in range(n_items):
            scores, ids, known = best[i]
            if len(scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(scores), asked.item[i])), pa.array(ids, mask=~known), pa.array(scores)],
                    ["item", "doc_id", "score"])

    return score


def _block_best(docs: DataFrame, block: DataFrame, k: int) -> DataFrame:
    """item, doc_id, score: at least the ``k`` best documents of the items of one block; written."""
    context = docs.sparkSession.sparkContext
    rows = block.select("item", "terms", "repeats").toPandas()     # bounded by BLOCK_TERMS
    hashes = np.unique(np.concatenate(rows["terms"].to_list()))
    wanted = context.broadcast(hashes)
    index = materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), term_counts("text", wanted).alias("t"))
        .where("t.n > 0").select("doc_id", "t.*"), "search-index")
    wanted.destroy()
    n_docs, total = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1)))
    counts = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    known = counts.select("term", "df", weight.cast("long").alias("w")).toPandas()    # at most one row per wanted term
    df, w = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
    df[known["term"]], w[known["term"]] = known["df"], known["w"]
    terms, weights = [], []
    for own, repeats in zip(rows["terms"], rows["repeats"], strict=True):
        at = np.searchsorted(hashes, own)
        order = np.lexsort((at, df[at]))
        order = order[w[at[order]] > 0]
        terms.append(at[order])
        weights.append(w[at[order]] * np.asarray(repeats)[order])
    items = context.broadcast(Items(rows["item"].to_numpy(np.int64), terms, weights))
    found = index.mapInArrow(_scorer(items, int(n_docs), int(total), k), "item bigint, doc_id bigint, score bigint")
    found = materialize(found, "search-best")
    items.destroy()
    return found


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best rows of ``docs`` (doc_id, text) for every row of ``items`` (item_id, text)."""
    asked = numbered_items(items)
    found = [
        _block_best(docs.select("doc_id", "text"), asked.where(F.col("block") == row.block), k)
        for row in asked.select("block").distinct().orderBy("block").toLocalIterator()
    ]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
