"""Quality rules from counts per text and from line frequencies across documents.

Lines are normalised to their words in lower case (A-Z) and hashed. For every host, here the ``source`` column, the
documents with a line are counted; exact copies of a text in a host count as one document, so that copies do not turn
an article into boilerplate. Lines in more than ``least`` documents and more than ``share`` of the host's documents
are removed, and a document of which less than ``remain`` of the words is left is depleted and rejected.

Counting groups by (host, line, text) first, so a frequent line is spread over its documents, and adds up partial
counts after that. Null texts have no words and fail the base rules; a null source is a host of its own. Repeated rows
each get a row of the result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from gleanmark.llm import arrays as A
from gleanmark.session import materialize

WINDOW = 8
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_TYPE = "struct<" + ",".join(f"{c}:bigint" for c in _COUNTS) + ",lines:array<struct<line:bigint,words:bigint>>>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _repeat_words(w: A.Words, hashes: np.ndarray, n_texts: int) -> np.ndarray:
    """Words per text that lie in a window of ``WINDOW`` words found twice or more in the text."""
    g = A.grams(hashes, w, WINDOW)
    _keys, back, counts = np.unique(A.within(g.hashes, g.text), return_inverse=True, return_counts=True)
    at = g.word[counts[back] > 1]
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return A.per_text(np.cumsum(cover[:-1]) > 0, w.first) if len(hashes) else np.zeros(n_texts, np.int64)


def _piece_counts(piece: A.Piece) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Counts per text; and the distinct normalised lines with a word: hash, words, first of each text."""
    w = A.words(piece)
    depth = np.zeros(len(piece.data) + 1, np.int64)
    np.add.at(depth, w.starts, 1)
    np.add.at(depth, w.ends, -1)
    inside = np.cumsum(depth[:-1]) > 0
    row = A.lines(piece)
    first, last = np.searchsorted(w.starts, row.starts), np.searchsorted(w.starts, row.ends)
    filled = last > first
    raw = A.span_hashes(piece.data, row.starts[filled], row.ends[filled])
    text = row.text[filled]
    n_lines = np.bincount(text, minlength=piece.n)
    _raw, at = np.unique(A.within(raw, text), return_index=True)
    distinct = np.bincount(text[at], minlength=piece.n)
    lower = A.span_hashes(piece.data, w.starts, w.ends, lower=True)
    normal = A.run_hashes(lower, first[filled], last[filled])
    _normal, at, back = np.unique(A.within(normal, text), return_index=True, return_inverse=True)
    n_words = np.bincount(back, (last - first)[filled], len(at)).astype(np.int64)
    order = np.lexsort((at, text[at]))
    counts = [
        np.diff(w.first),
        A.per_text(inside & A.starts_of_characters(piece.data), piece.offsets),
        A.per_text(_SYMBOL[piece.data], piece.offsets),
        n_lines - distinct,
        _repeat_words(w, A.span_hashes(piece.data, w.starts, w.ends), piece.n),
    ]
    return counts, normal[at][order], n_words[order], np.bincount(text[at], minlength=piece.n)



def _all_counts(column: pa.Array) -> pa.Array:
    parts = [_piece_counts(p) for p in A.pieces(column)]
    counts = [np.concatenate([p[0][i] for p in parts] or [np.zeros(0, np.int64)]) for i in range(len(_COUNTS))]
    hashes, words, sizes = (np.concatenate([p[i] for p in parts] or [np.zeros(0, np.int64)]) for i in (1, 2, 3))
    entries = pa.StructArray.from_arrays(
        [pa.array(hashes.view(np.int64)), pa.array(words.astype(np.int64))], ["line", "words"]
    )
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.StructArray.from_arrays(
        [*(pa.array(c.astype(np.int64)) for c in counts), pa.ListArray.from_arrays(offsets, entries)],
        [*_COUNTS, "lines"],
    )


def text_counts(text: str) -> Column:
    """Base counts of a text column and its distinct normalised lines."""

    @arrow_udf(_TYPE)
    def line_counts(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield _all_counts(column)

    return line_counts(text)


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, source, text_key and the counts of every document, written once for the steps that follow."""
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("text_key"), text_counts("text").alias("c"))
    return materialize(rows.select("doc_id", "source", "text_key", "c.*"), "line-rules")


def frequent_lines(rows: DataFrame, least: int, share: float) -> DataFrame:
    """source, line of the lines above both limits, from ``counted`` rows."""
    texts = rows.select("source", "text_key", "lines").dropDuplicates(["source", "text_key"])
    in_host = texts.groupBy("source").agg(F.count("*").alias("n_texts"))
    per_line = (
        texts.select("source", "text_key", F.explode("lines").alias("l"))
        .groupBy("source", F.col("l.line").alias("line")).agg(F.count("*").alias("n"))
        .where(F.col("n") > least)
    )
    same = per_line.source.eqNullSafe(in_host.source)
    return (
        per_line.join(in_host, same).where(F.col("n") > share * F.col("n_texts"))
        .select(per_line.source, "line", "n")
    )


def quality_rules(docs: DataFrame, least: int = 20, share: float = 0.1, remain: float = 0.3) -> DataFrame:
    """Counts, ``n_boilerplate_words``, base_failed and kept for every row of ``docs`` (doc_id, source, text)."""
    rows = counted(docs)
    frequent = frequent_lines(rows, least, share).select(F.col("source").alias("host"), F.col("line").alias("common"))
    removed = (
        rows.dropDuplicates(["source", "text_key"])
        .select("source", "text_key", F.explode("lines").alias("l"))
        .join(frequent, F.col("l.line").eqNullSafe(F.col("common")) & F.col("source").eqNullSafe(F.col("host")))
        .groupBy(F.col("source").alias("host"), F.col("text_key").alias("key"))
        .agg(F.sum("l.words").alias("n_removed"))
    )
    n_removed = F.coalesce("n_removed", F.lit(0).cast("long"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    depleted = (F.col("n_words") - n_removed) < remain * F.col("n_words")
    return (
        rows.drop("lines")
        .join(removed, F.col("text_key").eqNullSafe(F.col("key")) & F.col("source").eqNullSafe(F.col("host")), "left")
        .select("doc_id", *_COUNTS, n_removed.alias("n_boilerplate_words"), failed.alias("base_failed"),
                (~failed & ~depleted).alias("kept"))
    )
