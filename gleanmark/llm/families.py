"""Exact similarity links inside families of sets that met in a candidate search.

A family's sets are put in order of size and cut into blocks. First the pairs inside each block are compared by exact
intersection counts. Then pairs of blocks of compatible sizes meet, at first only as histograms of their shingles over
``BINS`` bins: the bin-wise minima bound an intersection from above, so only sets that may link to a set of the other
block, and are not in one component with it yet, send their texts to be compared exactly. A task holds two blocks at
most and returns a spanning forest of the links it found, so neither a large family nor all of its pairs ever lie in
one place.
"""
from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from gleanmark.llm import arrays as A
from gleanmark.llm.components import connected
from gleanmark.llm.frames import running_start
from gleanmark.session import materialize

BLOCK = 1024
FEW_BLOCKS = 8
BINS = 256
FEW = 24

#: Sorted distinct hashes of every text of a piece.
SetsOf = Callable[[A.Piece], list[np.ndarray]]
#: Links (a, b) of members (node, root, text) at a percentage.
LinksOf = Callable[[DataFrame, SetsOf, int], DataFrame]


class _Forest:
    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j


def linked(sets: list[np.ndarray], left: list[int], right: list[int], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``left``, or between ``left`` and ``right`` if there are any."""
    forest, out = _Forest(len(sets)), []
    if not right and len(left) <= FEW:
        for i, j in combinations(left, 2):
            a, b = len(sets[i]), len(sets[j])
            if 100 * min(a, b) < percent * max(a, b) or forest.root(i) == forest.root(j):
                continue
            same = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * same >= percent * (a + b - same) and forest.join(i, j):
                out.append((i, j))
        return out
    same, sizes_left, sizes_right = _common(sets, left, right)
    hits = 100 * same >= percent * (sizes_left[:, None] + sizes_right[None, :] - same)
    for i, j in np.argwhere(hits):
        x, y = left[i], (right or left)[j]
        if x != y and forest.join(x, y):
            out.append((x, y))
    return out


def _common(sets: list[np.ndarray], left: list[int], right: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intersection sizes as products of 0/1 matrices, some thousand shingles at a time; and the set sizes."""
    members = left + right
    sizes = np.array([len(sets[i]) for i in members])
    row = np.repeat(np.arange(len(members)), sizes)
    _values, column, counts = np.unique(np.concatenate([sets[i] for i in members]), return_inverse=True,
                                        return_counts=True)
    shared = counts > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    n = len(left)
    same = np.zeros((n, len(right) or n), np.float32)
    step = 4096
    cuts = np.searchsorted(column, np.arange(0, int(shared.sum()) + step, step))
    for k in range(len(cuts) - 1):
        part = slice(cuts[k], cuts[k + 1])
        dense = np.zeros((len(members), step), np.float32)
        dense[row[part], column[part] - k * step] = 1
        same += dense[:n] @ (dense[n:] if right else dense).T
    return same.astype(np.int64), sizes[:n], sizes[n:] if right else sizes


def _measures(sets_of: SetsOf):
    """Size and histogram (``BINS`` counts as 32-bit integers in one binary value) of a text's set."""

    @arrow_udf("struct<n:bigint,bins:binary>")
    def measures(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            n, bins = [], []
            for piece in A.pieces(column):
                for s in sets_of(piece):
                    n.append(len(s))
                    bins.append(np.bincount(A.mix(s) % np.uint64(BINS), minlength=BINS).astype(np.int32).tobytes())
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(bins, pa.binary())], ["n", "bins"])

    return measures


def _verify(members: DataFrame, sets_of: SetsOf, percent: int) -> DataFrame:
    """a, b: links inside the parts of ``members`` (unit, part, side, node, text)."""

    def links(group: pa.Table) -> pa.Table:
        node, part, side = (group.column(c).to_numpy() for c in ("node", "part", "side"))
        sets = [s for piece in A.pieces(group.column("text")) for s in sets_of(piece)]
        rows = defaultdict(lambda: ([], []))
        for i in range(len(node)):
            rows[int(part[i])][int(side[i])].append(i)
        out = [pair for left, right in rows.values() for pair in linked(sets, left, right, percent)]
        a, b = (np.array([node[p[k]] for p in out], np.int64) for k in (0, 1))
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return members.groupBy("unit").applyInArrow(links, "a bigint, b bigint")


def _possible(members: DataFrame, percent: int) -> DataFrame:
    """part, side, root, node of the members (these, component, bins) that may link across their part's sides."""

    def keep(group: pa.Table) -> pa.Table:
        side, node, component = (group.column(c).to_numpy() for c in ("side", "node", "component"))
        bins = np.frombuffer(b"".join(group.column("bins").to_pylist()), np.int32).reshape(-1, BINS)
        sizes = bins.sum(axis=1)
        right = np.flatnonzero(side == 1)
        needed = np.zeros(len(side), bool)
        for i in np.flatnonzero(side == 0):
            open_ = right[component[right] != component[i]]
            most = np.minimum(bins[open_], bins[i]).sum(axis=1)
            found = open_[100 * most >= percent * (sizes[open_] + sizes[i] - most)]
            needed[found] = True
            needed[i] = len(found) > 0
        chosen = group.filter(pa.array(needed))
        return chosen.select(["part", "side", "root", "node"])

    return members.groupBy("part").applyInArrow(keep, "part bigint, side int, root bigint, node bigint")


def verified(members: DataFrame, sets_of: SetsOf, percent: int, large: LinksOf | None = None) -> DataFrame:
    """a, b: links that span the components of similarity ``percent`` / 100 or more in every family.

    ``members`` has one row per family and node: node, root (the family), text. ``large`` compares the members of all
    families of more than ``FEW_BLOCKS`` blocks, ``in_blocks`` if it is not given.
    """
    members = materialize(members.select("node", "root", "text"), "family-texts")
    counts = members.groupBy("root").agg(F.count("*").alias("members"))
    over = materialize(counts.where(F.col("members") > BLOCK).select(F.col("root").alias("family"), "members"), "large-roots")
    n_units = max(1, members.count() // BLOCK)
    small = members.join(over, F.col("root") == F.col("family"), "left_anti").select(
        F.pmod(F.xxhash64("root"), F.lit(n_units)).alias("unit"), F.col("root").alias("part"), F.lit(0).alias("side"), "node", "text")
    found = _verify(small, sets_of, percent)
    few = F.col("members") <= FEW_BLOCKS * BLOCK
    for roots, links in ((over.where(few), in_blocks), (over.where(~few), large or in_blocks)):
        if not roots.isEmpty():
            found = found.unionByName(
                links(members.join(roots, F.col("root") == F.col("family"), "left_semi"), sets_of, percent))
    return found


def in_blocks(members: DataFrame, sets_of: SetsOf, percent: int) -> DataFrame:
    """Links of families of more than one block, block by block; what is sent grows with the square of a family."""
    texts = materialize(
        members.withColumn("m", _measures(sets_of)("text")).select("node", "root", "text", "m.*"), "large-families")
    # The order is by size and, as very many sets may have one size, by a part of the node within a size.
    sized = texts.select("node", "root", "n", "bins").withColumn("place", F.col("n") * 64 + F.pmod(F.xxhash64("node"), F.lit(64)))
    placed = materialize(
        running_start(sized, "root", "place", ["node"], None)
        .withColumn("block", F.floor(F.col("start") / BLOCK)).drop("start", "place"), "blocks",
    )
    own = F.xxhash64("root", "block")
    inside = placed.select("root", "node", own.alias("unit"), own.alias("part"), F.lit(0).alias("side"))
    text = texts.select("root", "node", "text")
    links = materialize(_verify(inside.join(text, ["root", "node"]), sets_of, percent), "links-inside")

    low = placed.groupBy("root", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    other = low.select(F.col("root").alias("root_"), F.col("block").alias("block_"), F.col("low").alias("low_"))
    pairs = low.join(other, (F.col("root") == F.col("root_")) & (F.col("block") < F.col("block_"))).where(
        100 * F.col("high") >= percent * F.col("low_"))
    sides = pairs.select("root", F.xxhash64("root", "block", "block_").alias("part"), F.explode(F.array(
        F.struct(F.col("block").alias("block"), F.lit(0).alias("side")),
        F.struct(F.col("block_").alias("block"), F.lit(1).alias("side")))).alias("x")).select("root", "part", "x.*")
    joined = connected(links).select(F.col("node").alias("linked_node"), F.col("root").alias("component"))
    across = (
        placed.join(sides, ["root", "block"])
        .join(joined, F.col("node") == F.col("linked_node"), "left")
        .select("part", "side", "root", "node", F.coalesce("component", "node").alias("component"), "bins")
    )
    open_ = _possible(across, percent).withColumn("unit", F.col("part"))
    return links.unionByName(_verify(open_.join(text, ["root", "node"]), sets_of, percent))
