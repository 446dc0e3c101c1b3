"""Exact k-nearest-neighbour distances and outlier flags for embeddings.

Vectors are assigned to the nearest of a few pivots.  Distances to the pivots
and the cell radii bound every distance (triangle inequality), so a vector
only visits the cells that can hold one of its neighbours.  Cells are cut into
blocks of bounded size by a hash of the id: a cell with a third of all vectors,
say copies of one text, is spread over many tasks.
"""
from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanmark.plans.ranks import values_at_ranks
from gleanmark.session import materialize

# Ship the helpers below with the tasks: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SCORE_SCALE = float(2**50)
_SLACK = 1e-6
# Distances held at once, values of a block of vectors, and blocks of all vectors.
_CHUNK = 1 << 22
_BLOCK_VALUES = 1 << 22
_BLOCKS = 16


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Rows scaled to unit length; zero vectors stay zero."""
    data = np.array(vectors.tolist(), dtype=np.float64)
    norm = np.linalg.norm(data, axis=1, keepdims=True)
    return data / np.where(norm == 0, 1.0, norm)


def _gap(cosine_distance: np.ndarray) -> np.ndarray:
    """Euclidean distance of unit vectors with the given cosine distance."""
    return np.sqrt(np.maximum(2.0 * cosine_distance, 0.0))


def _compare(queries: pd.DataFrame, targets: pd.DataFrame, k: int) -> list[list[float]]:
    """The k smallest cosine distances of each query, without itself."""
    target, target_ids = _matrix(targets["vec"]), targets["id"].to_numpy()
    best, rows = [], max(1, _CHUNK // max(1, len(targets)))
    for start in range(0, len(queries), rows):
        part = queries.iloc[start : start + rows]
        distance = np.clip(1.0 - _matrix(part["vec"]) @ target.T, 0.0, 2.0)
        distance[part["id"].to_numpy()[:, None] == target_ids[None, :]] = np.inf
        if distance.shape[1] > k:
            distance = np.partition(distance, k - 1, axis=1)[:, :k]
        best += [row[np.isfinite(row)].tolist() for row in np.sort(distance, axis=1)]
    return best


def rows_of_block(total: int, width: int, least: int) -> int:
    """Vectors of a block: a fixed part of all, so that what is sent grows with the table, within a task's memory."""
    return max(least, min(-(-total // _BLOCKS), _BLOCK_VALUES // max(1, width)))


def neighbour_distances(
    df: DataFrame, key: str, embedding: str, k: int, block_rows: int = 1024, pivots: int = 8
) -> DataFrame:
    """Mean cosine distance of every vector to its ``k`` nearest others.

    ``key`` is a unique integer.  With fewer than ``k`` others all are used; a
    lone vector scores 0.  ``pivots`` cells are cut into blocks of at least
    ``block_rows`` vectors.  Where the bounds rule out no cell, as for vectors
    spread evenly in many dimensions, all blocks meet: the cost is that of all
    pairs, and every vector is sent once for each block it meets.  So blocks
    grow with the table, and their number, but for the cells, stays near
    ``_BLOCKS`` until a block has ``_BLOCK_VALUES`` values.
    """
    given = df.schema[embedding].dataType.simpleString()
    shape = given if given == "array<float>" else "array<double>"
    vectors = df.select(F.col(key).cast("bigint").alias("id"), F.col(embedding).cast(shape).alias("vec"))
    total = vectors.count()
    centres = _matrix(
        vectors.orderBy(F.xxhash64("id"), "id").limit(pivots).toPandas()["vec"]
        if total else pd.Series([[0.0]])
    )
    block_rows = rows_of_block(total, centres.shape[1], block_rows)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            unit = _matrix(batch["vec"])
            gap = _gap(1.0 - unit @ centres.T)
            cell = gap.argmin(axis=1)
            away = gap[np.arange(len(cell)), cell]
            # A zero vector is at cosine distance 1 from all: it has no place
            # among the unit vectors, and keeps its cell open to every query.
            away = np.where(np.abs(unit).sum(axis=1) == 0, np.inf, away)
            yield batch.assign(cell=cell, away=away)

    placed = vectors.mapInPandas(assign, f"id bigint, vec {shape}, cell int, away double")
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).toPandas()
    blocks = np.ones(len(centres), dtype=np.int64)
    radius = np.full(len(centres), -1.0)
    for row in cells.itertuples():
        blocks[row.cell] = -(-row.n // block_rows)
        radius[row.cell] = row.radius
    used = radius >= 0
    n_blocks = F.array(*[F.lit(int(b)) for b in blocks])
    placed = placed.withColumn("n_blocks", F.get(n_blocks, F.col("cell"))).withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int")
    )

    # The k nearest within the own block bound the distance to the true ones.
    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        best = _compare(pdf, pdf, k)
        return pdf.assign(bound=[b[k - 1] if len(b) >= k else np.inf for b in best])

    bounded = materialize(
        placed.select("id", "vec", "cell", "block").groupBy("cell", "block").applyInPandas(
            within, f"id bigint, vec {shape}, cell int, block int, bound double"
        ),
        "neighbours",
    )

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            unit = _matrix(batch["vec"])
            reach = _gap(batch["bound"].to_numpy()) + _SLACK
            reach = np.where(np.abs(unit).sum(axis=1) == 0, np.inf, reach)
            needed = (_gap(1.0 - unit @ centres.T) - radius <= reach[:, None]) & used
            row, cell = np.nonzero(needed)
            yield batch.iloc[row][["id", "vec", "bound"]].assign(cell=cell.astype(np.int32))

    queries = bounded.mapInPandas(route, f"id bigint, vec {shape}, bound double, cell int")
    # In a cell every target block meets every block of the queries routed there.
    visits = np.ones(len(centres), dtype=np.int64)
    for row in queries.groupBy("cell").count().toPandas().itertuples():
        visits[row.cell] = -(-row[2] // block_rows)
    n_visits = F.array(*[F.lit(int(v)) for v in visits])
    queries = queries.withColumns(
        {
            "query_block": F.pmod(F.xxhash64("id"), F.get(n_visits, F.col("cell"))).cast("int"),
            "block": F.explode(F.sequence(F.lit(0), F.get(n_blocks, F.col("cell")) - 1)),
        }
    )
    targets = bounded.select("id", "vec", "cell", "block").withColumn(
        "query_block", F.explode(F.sequence(F.lit(0), F.get(n_visits, F.col("cell")) - 1))
    )

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"id": pd.Series(dtype="int64"), "best": pd.Series(dtype=object)})
        limits = left["bound"].to_numpy() + _SLACK
        best = [[d for d in found if d <= limit] for found, limit in zip(_compare(left, right, k), limits)]
        return pd.DataFrame({"id": left["id"].to_numpy(), "best": best})

    meeting = ["cell", "block", "query_block"]
    partial = queries.groupBy(*meeting).cogroup(targets.groupBy(*meeting)).applyInPandas(
        meet, "id bigint, best array<double>"
    )
    nearest = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k)
    partial = partial.groupBy("id").agg(nearest.alias("best"))
    mean = F.aggregate("best", F.lit(0.0), lambda acc, x: acc + x) / F.greatest(F.size("best"), F.lit(1))
    return partial.select(F.col("id").alias(key), mean.alias("outlier_score"))


def knn_outliers(
    df: DataFrame, key: str = "text_index", embedding: str = "embedding", k: int = 20,
    percentile: float = 95.0, block_rows: int = 1024, pivots: int = 8,
) -> DataFrame:
    """Flag the vectors whose neighbour distance lies above the percentile of all.

    The percentile interpolates between two order statistics, which are found
    without gathering the scores.
    """
    scores = materialize(neighbour_distances(df, key, embedding, k, block_rows, pivots), "scores")
    scores = scores.withColumn("_step", F.round(F.col("outlier_score") * _SCORE_SCALE).cast("bigint"))
    position = (F.col("n") - 1) * F.lit(percentile / 100.0)
    low = F.floor(position)
    ranks = {"_low": low + 1, "_high": F.least(low + 2, F.col("n"))}
    edges = values_at_ranks(scores, [], "_step", ranks, shifts=(34, 17, 0))
    limit = edges.filter(F.col("n") >= 2).select(
        F.col("_low") + (F.col("_high") - F.col("_low")) * (position - low)
    ).scalar()
    return scores.withColumn(
        "is_outlier", F.coalesce(F.col("_step").cast("double") > limit, F.lit(False))
    ).drop("_step")
