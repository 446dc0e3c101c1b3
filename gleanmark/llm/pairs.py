"""Exact similarity links among sets that met in a candidate search, pair by pair.

Sets meet in buckets, the entries with one key; in every bucket one set is its centre. Most buckets that are no
coincidence hold sets of one component, so the pairs are tried in two steps. First every set is compared with one of its
centres only, which joins copies to components. Then the buckets that still hold several components give all their pairs
across components. A bucket with more than ``PAIRED`` such sets does not write out its pairs; its sets go on as a family,
to be compared in blocks (see ``families``).

A pair is compared by its sizes, then by histograms of its shingles over ``BINS`` bins, whose bin-wise minima bound the
intersection from above, and what is left by its texts. Texts move for such pairs alone. All comparisons run row by row
in batches of bounded size; no step gathers a bucket, and copies of one set are one set from the start.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from gleanmark.llm import arrays as A
from gleanmark.llm import families
from gleanmark.llm.components import connected
from gleanmark.session import materialize

PAIRED = 32
BINS = 128
HOT_RUN = 16

ENTRIES = "part bigint, node bigint, first bigint, probe boolean"


def combined(key: np.ndarray, node: np.ndarray, probe: np.ndarray, hot_run: int = HOT_RUN) -> pa.RecordBatch:
    """``ENTRIES`` of many entries at once, so that a key in very many sets sends one entry from here and not all.

    Entries go on under their key, with themselves as ``first``. Of ``hot_run`` entries or more with one key only the
    first does: a look-up where there is one, else the smallest node. The others are met already: they name it and lie
    under a place of their own, the key exclusive-or the node.
    """
    order = np.lexsort((node, ~probe, key))
    key, node, probe = key[order], node[order], probe[order]
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    begin = np.flatnonzero(head)
    run = np.cumsum(head) - 1
    plain = head | (np.diff(np.append(begin, len(key))) < hot_run)[run]
    first = np.where(plain, node, node[begin[run]])
    part = np.where(plain, key, key ^ node)
    keep = plain | (node != first)
    return pa.RecordBatch.from_arrays(
        [pa.array(part[keep]), pa.array(node[keep]), pa.array(first[keep]), pa.array(np.where(plain, probe, probe[begin[run]])[keep])],
        ["part", "node", "first", "probe"])


def buckets(entries: DataFrame) -> DataFrame:
    """key, a, b: the centre ``a`` and each other set ``b`` of the buckets that a look-up entered; written.

    A bucket with many sets may have several centres that have a centre in common. Whether a set looks a key up follows
    from the set, so it is the same wherever its text stands.
    """
    order = Window.partitionBy("part").orderBy((F.col("node") != F.col("first")), F.desc("probe"), "node")
    order = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    alone = F.col("node") != F.col("first")
    met = materialize(
        entries.withColumn("centre", F.first("node").over(order)).withColumn("looked", F.first("probe").over(order))
        .select(
            F.when(alone, F.col("part").bitwiseXOR(F.col("node"))).otherwise(F.col("part")).alias("key"),
            F.when(alone, F.col("first")).otherwise(F.col("centre")).alias("a"), F.col("node").alias("b"),
            F.when(alone, F.col("probe")).otherwise(F.col("looked")).alias("sure"), alone.alias("alone"))
        .where("a <> b AND (sure OR alone)"),
        "met",
    )
    # Sets that met a set which looked nothing up count if that one met a look-up elsewhere.
    known = met.where("NOT alone").select(F.col("key").alias("k"), F.col("b").alias("centre"))
    later = met.where("NOT sure").join(known, (F.col("key") == F.col("k")) & (F.col("a") == F.col("centre")), "left_semi")
    return materialize(met.where("sure").unionByName(later).select("key", "a", "b"), "buckets")


def histogram(values: np.ndarray) -> bytes:
    """Numbers of shingles in each of ``BINS`` bins, as 16-bit integers; empty if one does not fit."""
    counts = np.bincount(A.mix(values) % np.uint64(BINS), minlength=BINS)
    return counts.astype("<u2").tobytes() if counts.max() < 1 << 16 else b""


def _may_link(percent: int):
    """Column function of two sizes and histograms."""

    @arrow_udf("boolean")
    def may_link(n_a: pa.Array, bins_a: pa.Array, n_b: pa.Array, bins_b: pa.Array) -> pa.Array:
        out = []
        for n, x, m, y in zip(n_a.to_pylist(), bins_a.to_pylist(), n_b.to_pylist(), bins_b.to_pylist(), strict=True):
            same = min(n, m)
            if x and y:
                same = int(np.minimum(np.frombuffer(x, "<u2"), np.frombuffer(y, "<u2")).sum())
            out.append(100 * same >= percent * (n + m - same))
        return pa.array(out, pa.bool_())

    return may_link


def compared(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, sets_of: families.SetsOf, percent: int) -> DataFrame:
    """a, b: those of the ``pairs`` (a, b) that link; written.

    ``sketches``: a written table (node, n, bins, doc_key); ``docs``: doc_key and text.
    """
    of = lambda side: sketches.select(
        F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("bins").alias(f"bins_{side}"))
    sized = pairs.join(of("a"), "a").join(of("b"), "b").where(
        100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    left = materialize(
        sized.where(_may_link(percent)("n_a", "bins_a", "n_b", "bins_b")).select("a", "b"), "pairs-left")
    wanted = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
    places = materialize(wanted.join(sketches.select("node", "doc_key"), "node"), "pair-texts-wanted").withColumnRenamed("doc_key", "k")
    held = docs.join(places, F.col("doc_key") == F.col("k")).groupBy("node").agg(F.min("text").alias("text"))
    texts = materialize(held, "pair-texts")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = ([s for piece in A.pieces(batch.column(i)) for s in sets_of(piece)] for i in (2, 3))
            hits = []
            for x, y in zip(first, second, strict=True):
                same = len(np.intersect1d(x, y, assume_unique=True))
                hits.append(100 * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(hits, pa.bool_()))

    rows = left.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")
    return materialize(rows.mapInArrow(links, "a bigint, b bigint"), "pair-links")


def links(met: DataFrame, sketches: DataFrame, docs: DataFrame, sets_of: families.SetsOf, percent: int,
          by_bucket: bool = False) -> DataFrame:
    """a, b: links that span the components of similarity ``percent`` / 100 or more among the sets of all buckets.

    ``met``: written, as ``buckets`` gives it. ``by_bucket``: sets have few keys, so where large buckets hang together in
    a family of many blocks, each is a family of its own; a set's text goes to every such bucket of the set.
    """
    tried = materialize(met.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "pairs-tried")
    near = compared(tried, sketches, docs, sets_of, percent)
    joined = connected(near)
    component = lambda side: joined.select(F.col("node").alias(f"node_{side}"), F.col("root").alias(f"root_{side}"))
    placed = met
    for side in ("a", "b"):
        placed = placed.join(component(side), F.col(side) == F.col(f"node_{side}"), "left").withColumn(
            f"in_{side}", F.coalesce(f"root_{side}", side)).drop(f"node_{side}", f"root_{side}")
    placed = materialize(placed, "buckets-placed")
    open_ = materialize(
        placed.groupBy("key").agg(F.count("*").alias("sets"), F.min("in_b").alias("low"), F.max("in_b").alias("high"))
        .where("low <> high").select(F.col("key").alias("k"), "sets"), "buckets-open")
    inside = placed.join(open_, F.col("key") == F.col("k"))
    few = inside.where(F.col("sets") <= PAIRED).select("key", "b", "in_b")
    other = few.toDF("other_key", "other", "in_other")
    across = few.join(other, (F.col("key") == F.col("other_key")) & (F.col("b") < F.col("other")) & (F.col("in_b") != F.col("in_other")))
    centres = placed.where("in_a <> in_b").select("a", "b").join(tried, ["a", "b"], "left_anti")
    more = centres.union(across.select("b", "other")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found = near.unionByName(compared(more, sketches, docs, sets_of, percent))
    many = materialize(inside.where(F.col("sets") > PAIRED).select("key", "a", "b"), "buckets-many")
    if many.isEmpty():
        return found
    members = connected(many.select("a", "b")).join(sketches.select(F.col("node").alias("n_"), F.col("doc_key").alias("k")), F.col("node") == F.col("n_"))
    texts = docs.join(members.select("node", "root", "k"), F.col("doc_key") == F.col("k"))
    texts = texts.groupBy("node").agg(F.min("root").alias("root"), F.min("text").alias("text"))

    def in_buckets(members: DataFrame, sets_of: families.SetsOf, percent: int) -> DataFrame:
        held = many.select("key", F.col("a").alias("held")).union(many.select("key", "b")).distinct()
        apart = held.join(members.select("node", "text"), F.col("held") == F.col("node"))
        return families.verified(apart.select("node", F.col("key").alias("root"), "text"), sets_of, percent)

    return found.unionByName(families.verified(texts, sets_of, percent, in_buckets if by_bucket else None))
