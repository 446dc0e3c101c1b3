"""Choosing examples to label: anti-join, clusters, uncertainty, ranking."""
from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from gleanmark import vocabulary as V
from gleanmark.functions import jsonvalue as J
from gleanmark.functions import text as TX
from gleanmark.operators.salvage import locate_json, parse_lenient
from gleanmark.session import materialize

# Ship the functions below with the tasks: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def drop_labeled(
    unlabeled: DataFrame, labeled: DataFrame, text: str = "text", key: str = "text_index",
    salts: int = 8,
) -> DataFrame:
    """Unlabelled rows whose trimmed text is not among the labelled ones.

    Joined on a digest of the text, so labelled texts are not shuffled.  Rows
    sharing one text are spread over ``salts`` partitions; the distinct
    labelled digests are repeated that often.
    """
    digest = F.sha2(TX.strip(F.col(text).cast("string")), 256)
    left = unlabeled.withColumns(
        {"_digest": digest, "_salt": F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")}
    )
    known = labeled.select(digest.alias("_digest")).distinct().select(
        "_digest", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    )
    return left.join(known, ["_digest", "_salt"], "left_anti").drop("_digest", "_salt")


def _fitted(vectors: DataFrame, k: int, seed: int, restarts: int) -> tuple:
    """The model with the lowest training cost of ``restarts`` runs, and the cost of each run.

    The driver only ever holds the ``k`` centres of two models.
    """
    from pyspark.ml.clustering import KMeans

    points = materialize(vectors.select(vector_to_array("_vector").alias("_point")), "cluster-points").select(
        array_to_vector("_point").alias("_vector"))
    best, costs = None, []
    for i in range(restarts):
        model = KMeans(k=k, seed=seed + i, featuresCol="_vector", predictionCol="cluster").fit(points)
        costs.append(model.summary.trainingCost)
        if costs[-1] == min(costs) and costs[-1] not in costs[:-1]:
            best = model
    return best, costs


def cluster(
    df: DataFrame, k: int = 100, seed: int = 42, restarts: int = 10, embedding: str = "embedding"
) -> DataFrame:
    """K-means cluster of each row: the best of ``restarts`` runs by training cost."""
    vectors = df.withColumn("_vector", array_to_vector(F.col(embedding)))
    return _fitted(vectors, k, seed, restarts)[0].transform(vectors).drop("_vector")


def cluster_invariants(
    df: DataFrame, key: str, k: int = 100, seed: int = 42, restarts: int = 10, embedding: str = "embedding"
) -> DataFrame:
    """What must hold for ``cluster``, measured on its result; one row.

    ``n_rows``; ``n_misplaced``: rows nearer to another centre than to their
    own; ``n_without_candidate``: clusters with no or several first rows
    (``one_per_cluster``); ``cost_is_least``: the summed squared distance to
    the own centres is not above that of any run.  The centres, ``k`` vectors,
    go to the tasks.
    """
    vectors = df.withColumn("_vector", array_to_vector(F.col(embedding)))
    model, costs = _fitted(vectors, k, seed, restarts)
    centres = np.array(model.clusterCenters())
    placed = materialize(
        model.transform(vectors).select(key, "cluster", vector_to_array("_vector").alias("_point")), "clusters")

    def distances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            point = np.array(batch["_point"].tolist()).reshape(len(batch), centres.shape[1])
            squares = ((point[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)
            own = squares[np.arange(len(batch)), batch["cluster"].to_numpy()]
            yield pd.DataFrame({"own": own, "nearest": squares.min(axis=1)})

    measured = placed.select("cluster", "_point").mapInPandas(distances, "own double, nearest double").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("own") > F.col("nearest") + 1e-9).alias("n_misplaced"),
        (F.coalesce(F.sum("own"), F.lit(0.0)) <= min(costs) * (1 + 1e-9)).alias("cost_is_least"),
    )
    first = one_per_cluster(placed.select(key, "cluster"), "cluster", key).groupBy("cluster").agg(F.count(F.lit(1)).alias("_firsts"))
    clusters = placed.select(F.col("cluster").alias("_cluster")).distinct()
    without = clusters.join(first, F.col("_cluster") == F.col("cluster"), "left").agg(
        F.count_if(F.coalesce("_firsts", F.lit(0)) != 1).alias("n")).scalar()
    return measured.withColumn("n_without_candidate", without)


def one_per_cluster(df: DataFrame, cluster: str = "cluster", order: str = "text_index") -> DataFrame:
    """The first row of every cluster; map-side combine keeps one row per task and cluster."""
    first = F.min_by(F.struct(*df.columns), F.col(order)).alias("_first")
    return df.groupBy(F.col(cluster).alias("_cluster")).agg(first).select("_first.*")


def _mean_of_pairs(distances: Column, n: Column) -> Column:
    """Mean of the distances of all pairs of ``n`` items; NULL below two items."""
    total = F.aggregate(distances, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(n >= 2, total / (n * (n - 1) / 2))


def pair_mean(items: Column, distance: Callable[[Column, Column], Column]) -> Column:
    """Mean of ``distance`` over the pairs i<j of a short array; NULL below two items."""
    n = F.size(items)
    of_first = lambda i: F.transform(
        F.sequence(i + 1, n - 1), lambda j: distance(F.get(items, i), F.get(items, j))
    )
    return _mean_of_pairs(F.flatten(F.transform(F.sequence(F.lit(0), n - 2), of_first)), n)


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance in code points, exact at any length.

    A column of the table is two integers, the bits of its steps up and down,
    so a character of the shorter text costs a few operations on integers
    (Myers 1999, Hyyrö 2003).
    """
    if a == b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, char in enumerate(a):
        places[char] = places.get(char, 0) | (1 << i)
    full = (1 << len(a)) - 1
    rises, falls = full, 0
    for char in b:
        at = places.get(char, 0)
        # Bits past the last character never reach the lower ones; they go from ``falls`` at the end.
        same = (((at & rises) + rises) ^ rises) | at | falls
        right = ((falls | (full ^ (same | rises))) << 1) | 1
        rises, falls = (((rises & same) << 1) | (full ^ (same | right))) & full, right & same
    return len(b) + rises.bit_count() - (falls & full).bit_count()


def _relative_distances(responses: Column) -> Column:
    """Edit distance of every pair i<j relative to its longer text; NULL where a text is."""

    @arrow_udf("array<double>")
    def distances(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def relative(a: str | None, b: str | None) -> float | None:
            return None if a is None or b is None else edit_distance(a, b) / max(len(a), len(b), 1)

        for column in columns:
            yield pa.array(
                [None if r is None else [relative(a, b) for i, a in enumerate(r) for b in r[i + 1 :]] for r in column.to_pylist()],
                pa.list_(pa.float64()),
            )

    return distances(responses)


def generation_disagreement(responses: Column) -> Column:
    """Mean pairwise edit distance relative to the longer response; 0 below two responses."""
    return F.coalesce(_mean_of_pairs(_relative_distances(responses), F.size(responses)), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets: 1 if both are empty, 0 if one is."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(
        F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1))
    )


def _truthy(value: Column) -> Column:
    shape = J.kind(value)
    number = F.try_variant_get(value, "$", "double")
    text = F.try_variant_get(value, "$", "string")
    falsy = (
        J.is_null(value)
        | ((shape == "STRING") & (text == ""))
        | ((shape == "BOOLEAN") & (text == "false"))
        | ((shape.isin("BIGINT", "DOUBLE", "FLOAT") | shape.startswith("DECIMAL")) & (number == 0))
        | (J.is_array(value) & (F.size(J.items(value)) == 0))
        | (shape == "OBJECT<>")
    )
    return ~F.coalesce(falsy, F.lit(False))


def fact_set(record: Column) -> Column:
    """Distinct facts of a record as texts, values written as in the record."""

    def fact(tag: str, key: Column, value: Column) -> Column:
        return F.when(
            _truthy(key), F.concat(F.lit(tag + "\u0001"), J.shown(key), F.lit(":"), value)
        )

    def mass_fact(item: Column) -> Column:
        fraction = J.get(item, V.MASS)
        return fact(
            "mass", J.get(item, V.SUBSTANCE),
            F.when(fraction.isNull(), F.lit("")).otherwise(J.shown(fraction)),
        )

    def other_fact(item: Column) -> Column:
        candidates = [J.get(item, key) for key in V.FACT_VALUE_KEYS]
        value = F.coalesce(*[F.when(_truthy(c), J.shown(c)) for c in candidates], J.shown(candidates[-1]))
        return fact("other", J.get(item, V.PARAMETER), value)

    return F.array_distinct(
        F.array_compact(
            F.concat(
                F.transform(J.items(J.get(record, V.MASS)), mass_fact),
                F.transform(J.items(J.get(record, V.OTHER)), other_fact),
            )
        )
    )


def _structure_distance(a: Column, b: Column) -> Column:
    """Half the share of differing keys plus half the share of list keys of other length."""
    union = F.size(F.array_union(a["keys"], b["keys"]))
    shared = F.size(F.array_intersect(a["keys"], b["keys"]))
    key_diff = (union - shared) / F.greatest(union, F.lit(1))
    names = lambda side: F.transform(side["lists"], lambda e: e["key"])
    length = lambda side, key: F.coalesce(
        F.try_element_at(F.map_from_entries(side["lists"]), key), F.lit(0)
    )
    list_keys = F.array_union(names(a), names(b))
    differing = F.size(F.filter(list_keys, lambda k: length(a, k) != length(b, k)))
    length_diff = differing / F.greatest(F.size(list_keys), F.lit(1))
    return (key_diff + length_diff) / 2


def score_uncertainty(
    candidates: DataFrame, key: str = "text_index", responses: str = "responses",
    alpha: float = 0.33, beta: float = 0.33, gamma: float = 0.34,
) -> DataFrame:
    """Uncertainty measures and best JSON of candidates with their ``k`` sampled responses.

    ``key`` is unique, and ``k`` small.  Each response is salvaged as a row of
    its own; only the summaries are brought together per candidate.
    """
    rows = candidates.select(key, F.posexplode_outer(responses).alias("_pos", "_response"))
    rows = locate_json(rows, "_response", "_located")
    rows = parse_lenient(rows, "_located", "_record")
    record = F.col("_record")
    lists = F.transform_values(
        F.map_filter(J.members(record), lambda k, v: J.is_array(v)), lambda k, v: F.size(J.items(v))
    )
    summary = F.when(
        F.col("_pos").isNotNull(),
        F.struct(
            F.col("_pos").alias("pos"),
            J.is_nonempty_object(record).alias("valid"),
            J.is_object(record).alias("object"),
            J.keys(record).alias("keys"),
            F.map_entries(lists).alias("lists"),
            fact_set(record).alias("facts"),
            (~TX.is_blank(F.col("_response"))).alias("filled"),
            F.col("_located").alias("located"),
        ),
    )
    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list(summary)).alias("_s"))
    joined = candidates.join(grouped, key)
    k = F.size("_s")
    valid = F.filter("_s", lambda s: s["valid"])
    objects = F.filter("_s", lambda s: s["object"])
    r_fail = F.when(k == 0, 1.0).otherwise(1 - F.size(valid) / F.greatest(k, F.lit(1)))
    joined = joined.withColumns(
        {
            "generation_disagreement": generation_disagreement(F.col(responses)),
            "r_fail": r_fail,
            "structural_disagreement": F.when(k == 0, 1.0)
            .when(F.size(valid) < 2, F.when(F.size(valid) < k, 1.0).otherwise(0.0))
            .otherwise(pair_mean(valid, _structure_distance)),
            "content_uncertainty": F.coalesce(
                1 - pair_mean(objects, lambda a, b: jaccard(a["facts"], b["facts"])), F.lit(1.0)
            ),
            "json": _best_json(F.col("_s")),
        }
    ).withColumn("format_uncertainty", (F.col("r_fail") + F.col("structural_disagreement")) / 2)
    return joined.withColumn(
        "total_uncertainty",
        alpha * F.col("generation_disagreement")
        + beta * F.col("format_uncertainty")
        + gamma * F.col("content_uncertainty"),
    ).drop("_s")


def _best_json(summaries: Column) -> Column:
    """JSON text of the first response that reads as an object, else of the first with any."""
    parsed = F.filter(summaries, lambda s: s["filled"] & s["object"])
    any_text = F.filter(summaries, lambda s: s["filled"] & (s["located"] != ""))
    return F.coalesce(
        F.get(parsed, F.lit(0))["located"], F.get(any_text, F.lit(0))["located"], F.lit("")
    )


def rank_uncertain(scored: DataFrame, n: int, tie: str = "text_index") -> DataFrame:
    """The ``n`` most uncertain candidates, ties by ``tie``."""
    return scored.orderBy(F.desc("total_uncertainty"), F.asc(tie)).limit(n)


def fewshot_block(pool: DataFrame, order: str = "pos", by: str = "model_key", n: int = 5) -> DataFrame:
    """Prompt block of the first ``n`` examples of every model."""
    first = pool.withColumn(
        "_n", F.row_number().over(Window.partitionBy(by).orderBy(order))
    ).filter(F.col("_n") <= n)
    number = F.col("_n").cast("string")
    labelled = lambda label, col: F.concat(
        F.lit(label + " "), number, F.lit(": "), F.coalesce(TX.strip(F.col(col)), F.lit("nan"))
    )
    example = F.concat_ws(
        "\n\n",
        labelled(V.EXAMPLE_TEXT_LABEL, "text"),
        labelled(V.EXAMPLE_ANSWER_LABEL, "json"),
    )
    pairs = F.array_sort(F.collect_list(F.struct("_n", example.alias("e"))))
    return first.groupBy(by).agg(
        F.array_join(F.transform(pairs, lambda p: p["e"]), "\n\n").alias("block")
    )


def latest_pool(files: DataFrame) -> DataFrame:
    """The pool file to use per model: XLSX before CSV, then the newest.

    ``files`` has (model_key, path, mtime).
    """
    rank = F.struct(F.lower("path").endswith(".xlsx").cast("int"), F.col("mtime"), F.col("path"))
    return files.groupBy("model_key").agg(F.max_by("path", rank).alias("path"))
