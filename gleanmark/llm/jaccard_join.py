"""Self-join of documents by the Jaccard similarity of their word n-grams, exact, by universe partitioning.

The universe of shingles is cut into segments by a hash. Sets are put into bands by size; a band fixes the number of
segments m. Two sets that link differ in at most H shingles, so if a set looks up its segments with tolerances a_i
(-1 skipped, 0 equal, 1 one shingle more or less) with sum(a_i + 1) > H, it meets every partner in one of them.

* Index: every set enters the subsets of all segments of its band, and the one-deletion neighbourhoods of some.
* Probe: every set, in its band and in the band below if partners can lie there, takes the cheapest allocation that
  reaches its own H + 1: hot or empty segments are skipped, others give one unit when looked up as they are and a
  second one with their one-deletion neighbourhoods. Costs are frequencies of subsets, estimated on one text in
  ``COST_SAMPLE``; they steer this choice only, any allocation finds every pair.
* Sets that meet are verified pair by pair, by exact counts (see ``pairs``).

Documents with equal sets are one node from the start, so copies are not expanded. Words are lower-cased (A-Z) runs
outside white space; a text with fewer words than a shingle has one shingle of all of them. Sets are sets of 64-bit
hashes. Null, empty and wordless texts have an empty set and link with nothing. Repeated rows link like other copies.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from gleanmark.llm import arrays as A
from gleanmark.llm import pairs
from gleanmark.llm.components import connected
from gleanmark.session import materialize

COST_SAMPLE = 16
HOT_AT, HOT_LIST = 4, 1 << 15
DELETION_SHARE = 16
COMBINED = 1 << 19      # entries that a task combines at a time
_SALT = np.uint64(0x2545F4914F6CDD1D)


@dataclass(frozen=True)
class Rule:
    """Shingle length and the similarity, in hundredths, from which on two sets link."""

    words: int = 5
    percent: int = 80

    @property
    def growth(self) -> float:
        """Sizes of a band span this factor."""
        return (100 / self.percent) ** 2

    def band(self, n: np.ndarray) -> np.ndarray:
        found = np.floor(np.log(np.maximum(n, 1)) / math.log(self.growth)).astype(np.int64)
        found -= self.low(found) > n
        return found + (self.low(found + 1) <= n)

    def low(self, band: np.ndarray) -> np.ndarray:
        """Smallest size of a band."""
        return np.ceil(self.growth ** np.asarray(band, np.float64) - 1e-9).astype(np.int64)

    def most_apart(self, n: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Largest number of shingles in just one of two linked sets of these sizes."""
        total = n + other
        return total - 2 * (-(-self.percent * total // (100 + self.percent)))

    def largest_partner(self, n: np.ndarray) -> np.ndarray:
        return 100 * n // self.percent

    def units(self, n: np.ndarray, top: np.ndarray) -> np.ndarray:
        """Units that a set of size ``n`` looks up to meet every partner of at most ``top`` shingles.

        ``most_apart`` goes up and down by one from a total size to the next, but never falls over two of them, so the
        largest total and the one before it bound all partners.
        """
        partner = np.minimum(self.largest_partner(n), top)
        return np.maximum(self.most_apart(n, partner), self.most_apart(n, partner - 1)) + 1

    def segments(self, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of segments of a band, and how many of them have one-deletion neighbourhoods in the index.

        There is a segment for every unit that any set may need. The neighbourhoods come on top, so that sets can skip
        some segments: empty ones, which very many sets share, and hot ones.
        """
        top = self.low(np.asarray(band) + 1) - 1
        units = self.most_apart(top, self.largest_partner(top)) + 1
        return units, np.where(units > 1, np.minimum(units, np.maximum(2, units // DELETION_SHARE)), 0)


class Sets:
    """Distinct shingle hashes of the texts of a piece, sorted within each text."""

    def __init__(self, piece: A.Piece, words: int) -> None:
        w = A.words(piece)
        hashes = A.span_hashes(piece.data, w.starts, w.ends, lower=True)
        g = A.grams(hashes, w, words)
        counts = np.diff(w.first)
        short = np.flatnonzero((counts > 0) & (counts < words))
        whole = A.mix(A.run_hashes(hashes, w.first[short], w.first[short + 1]) + _SALT)
        values, text = np.concatenate([g.hashes, whole]), np.concatenate([g.text, short])
        self.values, self.first = A.sorted_sets(values, text, piece.n)
        self.n = np.diff(self.first)
        sums = np.zeros(len(self.values) + 1, np.uint64)
        np.cumsum(A.mix(self.values ^ _SALT), out=sums[1:])
        #: One number per set; equal sets have the same one.
        self.node = A.mix(sums[self.first[1:]] - sums[self.first[:-1]] + self.n.astype(np.uint64)).view(np.int64)


def _key(total: np.ndarray, band: np.ndarray, segment: np.ndarray, space: int) -> np.ndarray:
    place = (band.astype(np.uint64) << np.uint64(33)) | (segment.astype(np.uint64) << np.uint64(1)) | np.uint64(space)
    return A.mix(total ^ A.mix(place + _SALT)).view(np.int64)


def signatures(sets: Sets, rows: np.ndarray, band: np.ndarray, rule: Rule, hot: np.ndarray, cost: np.ndarray,
               index: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, set numbers and whether a look-up, of the sets ``rows`` in the bands ``band``.

    ``index``: the sets also enter the index of that band. ``hot``, ``cost``: sorted keys of frequent subsets and costs.
    """
    empty = np.zeros(0, np.int64)
    if not len(rows):
        return empty, empty, empty.astype(bool)
    m, d = rule.segments(band)
    n = sets.n[rows]
    first_bin = np.concatenate([[0], np.cumsum(m)])
    element = np.repeat(sets.first[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
    owner = np.repeat(np.arange(len(rows)), n)
    value = sets.values[element]
    segment = (A.mix(value + _SALT) % m[owner].astype(np.uint64)).astype(np.int64)
    bin_ = first_bin[owner] + segment
    code = A.mix(value)
    total = np.zeros(first_bin[-1], np.uint64)
    np.add.at(total, bin_, code)
    held = np.bincount(bin_, minlength=first_bin[-1])
    bin_owner = np.repeat(np.arange(len(rows)), m)
    bin_segment = np.arange(first_bin[-1]) - first_bin[bin_owner]
    exact = _key(total, band[bin_owner], bin_segment, 0)

    price = np.where(held == 0, 1e9, 0.0)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, exact), len(hot) - 1)
        price += np.where(hot[at] == exact, cost[at], 0)
    deletable = np.flatnonzero(bin_segment < d[bin_owner])
    unit_owner = np.concatenate([bin_owner, bin_owner[deletable]])
    unit_price = np.concatenate([price, price[deletable] + 0.5 + held[deletable] * 1e-3])
    top = rule.low(band + 1) - 1
    need = rule.units(n, top)
    order = np.lexsort((np.arange(len(unit_owner)), unit_price, unit_owner))
    rank = np.empty(len(order), np.int64)
    n_units = m + np.bincount(bin_owner[deletable], minlength=len(rows))
    rank[order] = np.arange(len(order)) - np.repeat(np.cumsum(n_units) - n_units, n_units)
    chosen = rank < need[unit_owner]
    looked, loose = chosen[: len(bin_owner)], np.zeros(len(bin_owner), bool)
    loose[deletable] = chosen[len(bin_owner) :]

    keys, owners, probes = [], [], []

    def add(key: np.ndarray, owner_: np.ndarray, probe: np.ndarray | bool) -> None:
        keys.append(key)
        owners.append(rows[owner_])
        probes.append(np.broadcast_to(probe, len(key)))

    if index:
        add(exact, bin_owner, looked)
    else:
        add(exact[looked], bin_owner[looked], True)
    add(_key(total[loose], band[bin_owner[loose]], bin_segment[loose], 1), bin_owner[loose], True)
    in_loose = loose[bin_]
    less = total[bin_] - code
    add(_key(less[in_loose], band[owner[in_loose]], segment[in_loose], 0), owner[in_loose], True)
    if index:
        entered = segment < d[owner]
        add(_key(less[entered], band[owner[entered]], segment[entered], 1), owner[entered], False)
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(probes)


def with_sets(rule: Rule):
    """Column function: struct of the number of shingles, the node and the histogram of a text's set."""
    words = rule.words

    @arrow_udf("struct<n:bigint,node:bigint,bins:binary>")
    def shingle_set(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            n, node, bins = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
            for piece in A.pieces(column):
                s = Sets(piece, words)
                n.append(s.n)
                node.append(s.node)
                bins += [pairs.histogram(s.values[a:b]) for a, b in zip(s.first[:-1], s.first[1:], strict=True)]
            yield pa.StructArray.from_arrays(
                [pa.array(np.concatenate(n).astype(np.int64)), pa.array(np.concatenate(node)), pa.array(bins, pa.binary())],
                ["n", "node", "bins"])

    return shingle_set


def _subset_keys(docs: DataFrame, rule: Rule) -> DataFrame:
    """key of the subsets of all segments of every text: for the costs."""
    none = np.zeros(0, np.int64)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in A.pieces(batch.column(0)):
                sets = Sets(piece, rule.words)
                rows = np.flatnonzero(sets.n)
                band = rule.band(sets.n[rows])
                m, _d = rule.segments(band)
                found = signatures(sets, rows, band, rule, none, none, True)[0][: int(m.sum())]
                yield pa.RecordBatch.from_arrays([pa.array(found)], ["key"])

    return docs.select("text").mapInArrow(keys, "key bigint")


def frequent_subsets(docs: DataFrame, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Keys and estimated frequencies of at most ``HOT_LIST`` frequent subsets, sorted by key.

    An estimate for costs, from the texts whose hash is a multiple of ``COST_SAMPLE``; copies count once.
    """
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(COST_SAMPLE)) == 0).select("text").distinct()
    counts = (
        _subset_keys(sample, rule).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= HOT_AT)
        .orderBy(F.desc("n"), "key").limit(HOT_LIST).toPandas().sort_values("key")
    )
    return counts["key"].to_numpy(np.int64), counts["n"].to_numpy(np.float64)


def met(docs: DataFrame, rule: Rule) -> DataFrame:
    """key, a, b: the buckets of sets that meet in a subset which one of them looks up."""
    hot, cost = frequent_subsets(docs, rule)
    shared = docs.sparkSession.sparkContext.broadcast((hot, cost))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, cost = shared.value
        seen: set[int] = set()
        held, size = [], 0
        for batch in batches:
            for piece in A.pieces(batch.column(0)):
                sets = Sets(piece, rule.words)
                _nodes, first = np.unique(sets.node, return_index=True)
                rows = np.array([i for i in first if sets.n[i] and int(sets.node[i]) not in seen], np.int64)
                seen.update(sets.node[rows].tolist())
                band = rule.band(sets.n[rows])
                below = rows[rule.largest_partner(rule.low(band) - 1) >= sets.n[rows]]
                below = below[rule.band(sets.n[below]) > 0]
                for key, owner, probe in (signatures(sets, rows, band, rule, hot, cost, True),
                                          signatures(sets, below, rule.band(sets.n[below]) - 1, rule, hot, cost, False)):
                    held.append((key, sets.node[owner], probe))
                    size += len(key)
                if size >= COMBINED:
                    yield pairs.combined(*map(np.concatenate, zip(*held, strict=True)))
                    held, size = [], 0
        if held:
            yield pairs.combined(*map(np.concatenate, zip(*held, strict=True)))

    found = pairs.buckets(docs.select("text").mapInArrow(emit, pairs.ENTRIES))
    shared.destroy()
    return found


def links(docs: DataFrame, known: DataFrame, rule: Rule) -> DataFrame:
    """a, b: exact links between nodes that span the components. ``known``: doc_key, n, node, bins of ``docs``, written."""
    found = met(docs, rule)
    nodes = found.select(F.col("a").alias("met_node")).union(found.select("b")).distinct()
    sketches = materialize(
        known.where("n > 0").groupBy("node").agg(F.min(F.struct("doc_key", "n", "bins")).alias("s"))
        .join(nodes, F.col("node") == F.col("met_node")).select("node", "s.*"), "sketches")
    words = rule.words

    def sets_of(piece: A.Piece) -> list[np.ndarray]:
        s = Sets(piece, words)
        return [s.values[s.first[i] : s.first[i + 1]] for i in range(piece.n)]

    keyed = docs.select(F.xxhash64("doc_id", "text").alias("doc_key"), "text")
    return pairs.links(found, sketches, keyed, sets_of, rule.percent)


def similar(docs: DataFrame, rule: Rule, text: str = "text") -> DataFrame:
    """doc_id, doc_key, n_shingles, group and component_id (smallest id that links reach) of every row of ``docs``.

    ``doc_key`` is a hash of id and text; ``group`` is the same number for all of a component.
    """
    docs = docs.select("doc_id", F.col(text).alias("text"))
    known = materialize(
        docs.select("doc_id", F.xxhash64("doc_id", "text").alias("doc_key"), with_sets(rule)("text").alias("s"))
        .select("doc_id", "doc_key", "s.*"), "shingle-sets",
    )
    roots = connected(links(docs, known, rule)).select(F.col("node").alias("linked_node"), "root")
    rooted = known.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("smallest")).join(
        roots, F.col("node") == F.col("linked_node"), "left").select(
        "node", "smallest", F.coalesce("root", "node").alias("group"))
    lowest = rooted.groupBy("group").agg(F.min("smallest").alias("component_id"))
    named = rooted.join(lowest, "group").select(F.col("node").alias("named_node"), "group", "component_id")
    return known.join(named, (F.col("node") == F.col("named_node")) & (F.col("n") > 0), "left").select(
        "doc_id", "doc_key", F.col("n").alias("n_shingles"), F.coalesce("group", "doc_key").alias("group"),
        F.coalesce("component_id", "doc_id").alias("component_id"))
