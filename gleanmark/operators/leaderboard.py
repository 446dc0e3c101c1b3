"""Leaderboards: model by method tables with deltas to a baseline method.

Input is the long cell table (model_key, method, value).  It has one row per
model and method, the product of an aggregation over the runs.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanmark import vocabulary as V
from gleanmark.functions import numbers as N

_LAST = 9999


@dataclass(frozen=True)
class Metric:
    """How a metric is shown and judged."""

    digits: int
    delta_digits: int
    lower_is_better: bool = False
    zero_is_empty: bool = False
    marks_best: bool = False


METRICS = {
    "f1": Metric(4, 2, zero_is_empty=True, marks_best=True),
    "latency": Metric(3, 3, lower_is_better=True, zero_is_empty=True, marks_best=True),
    "gpu": Metric(2, 2, lower_is_better=True),
    "validation": Metric(2, 2),
}


def method_alias(method: Column) -> Column:
    """Short title of a method, else the initials of its parts."""
    titles = F.create_map(*[F.lit(x) for pair in V.METHOD_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(titles, method), acronym(method))


def acronym(method: Column) -> Column:
    """Initials of the parts of a method's name."""
    parts = F.filter(F.transform(F.split(method, "_"), F.trim), lambda p: p != "")
    initials = F.array_join(F.transform(parts, lambda p: F.upper(F.left(p, F.lit(1)))), "")
    return F.when(F.size(parts) > 0, initials).otherwise(F.left(F.upper(method), F.lit(4)))


def alias_number(alias: Column) -> Column:
    """Leading number of a title; titles without one go last."""
    digits = F.regexp_extract(alias, r"^(\d+)\.", 1)
    return F.coalesce(digits.try_cast("int"), F.lit(_LAST))


def with_alias(cells: DataFrame) -> DataFrame:
    """Add ``alias`` and ``method_order`` (title number; then order by name)."""
    return cells.withColumn("alias", method_alias(F.col("method"))).withColumn(
        "method_order", alias_number(F.col("alias"))
    )


def main_methods(cells: DataFrame) -> DataFrame:
    """Cells of the main table: runs through a serving backend are left out."""
    served = F.lit(False)
    for prefix in V.BACKEND_PREFIXES:
        served = served | F.col("method").startswith(prefix)
    return cells.filter(~served)


def baseline_method(cells: DataFrame) -> Column:
    """Name of the baseline method: the first named BASELINE, else the first.

    A scalar subquery, so the plan stays lazy.
    """
    named = F.upper("method").contains("BASELINE")
    order = F.struct((~named).cast("int"), alias_number(method_alias(F.col("method"))), F.col("method"))
    return cells.agg(F.min_by("method", order)).scalar()


def leaderboard(
    cells: DataFrame, metric: str, baseline: str | None = None, rounded: bool = False
) -> DataFrame:
    """Value, delta to the model's own baseline value, sign, best mark and cell text.

    F1 and latency treat zero as no value.  Sign is +1 where the change is an
    improvement, -1 where it is not.  For ``validation`` the table also has
    ``raw`` and the sign marks a parsed rate of one; ``rounded`` computes its
    deltas from two-decimal rates.
    """
    rule = METRICS[metric]
    base = F.lit(baseline) if baseline is not None else baseline_method(cells)
    value = F.col("value").cast("double")
    if rounded:
        value = N.fixed(value, 2).cast("double")
    table = with_alias(cells).withColumn("value", value).withColumn("_is_base", F.col("method") == base)
    own = F.max(F.when(F.col("_is_base"), F.col("value"))).over(Window.partitionBy("model_key"))
    table = table.withColumn("baseline_value", own)
    if rule.zero_is_empty:
        empty = F.col("value").isNull() | (F.abs("value") < 1e-6)
    else:
        empty = F.col("value").isNull()
    change = F.when(~empty & ~F.col("_is_base"), F.col("value") - F.col("baseline_value"))
    gain = -F.col("delta") if rule.lower_is_better else F.col("delta")
    if metric == "validation":
        sign = F.when(F.abs(F.col("value") - 1.0) < 1e-6, 1).otherwise(0)
    else:
        sign = F.when(~empty, F.coalesce(F.signum(gain), F.lit(0))).otherwise(0)
    table = table.withColumn("delta", change).withColumns(
        {"empty": empty, "sign": sign.cast("int")}
    )
    if metric == "validation":
        raw = F.col("raw") if "raw" in cells.columns else F.lit(None).cast("double")
        text = F.concat(N.fixed(F.col("value"), 2), F.lit("\n("), N.fixed(raw, 2), F.lit(")"))
    else:
        text = F.concat(
            N.fixed(F.col("value"), rule.digits),
            F.coalesce(
                F.concat(F.lit("\n("), N.fixed(F.col("delta"), rule.delta_digits, signed=True), F.lit(")")),
                F.lit(""),
            ),
        )
    table = table.withColumn("cell", F.when(empty, F.lit("-")).otherwise(F.coalesce(text, F.lit("-"))))
    if rule.marks_best:
        goodness = F.col("value") if rule.lower_is_better else -F.col("value")
        order = F.when(~F.col("empty"), F.struct(goodness, F.col("model_key")))
        best = F.min_by("model_key", order).over(Window.partitionBy("method"))
        table = table.withColumn("is_best", F.coalesce(F.col("model_key") == best, F.lit(False)))
    else:
        table = table.withColumn("is_best", F.lit(False))
    return table.drop("_is_base")


def best_per_method(cells: DataFrame, lower_is_better: bool = False) -> DataFrame:
    """The best model of every method, the first by name on ties."""
    goodness = F.col("value") if lower_is_better else -F.col("value")
    order = F.struct(goodness, F.col("model_key"))
    return cells.groupBy("method").agg(
        F.min_by("model_key", order).alias("model_key"), F.min_by("value", order).alias("value")
    )


def avg_delta(board: DataFrame, metric: str) -> DataFrame:
    """Mean delta per method over the models that have both values.

    The baseline itself and methods without any pair have NULL (shown "-").
    """
    rule = METRICS[metric]
    delta = F.col("delta")
    if rule.zero_is_empty:
        delta = F.when(F.abs("baseline_value") >= 1e-6, delta)
    out = board.groupBy("method", "alias", "method_order").agg(F.avg(delta).alias("avg_delta"))
    gain = -F.col("avg_delta") if rule.lower_is_better else F.col("avg_delta")
    return out.withColumns(
        {
            "cell": F.coalesce(N.fixed(F.col("avg_delta"), rule.delta_digits, signed=True), F.lit("-")),
            "sign": F.coalesce(F.signum(gain), F.lit(0)).cast("int"),
        }
    )


def matrix(board: DataFrame, methods: Sequence[str] | None = None, cell: str = "cell") -> DataFrame:
    """Model by method view of a leaderboard, "-" where a model has no such run."""
    wide = board.groupBy("model_key").pivot("method", list(methods) if methods else None)
    return wide.agg(F.first(cell)).fillna("-")


def backend_slice(cells: DataFrame, prefix: str, baseline: str = V.BASELINE_METHOD) -> DataFrame:
    """Methods served through one backend, with the local baseline of those models."""
    served = cells.filter(F.col("method").startswith(prefix))
    local = cells.filter(F.col("method") == baseline).join(
        served.select("model_key").distinct(), "model_key", "left_semi"
    )
    return served.unionByName(local)


def split_quant(df: DataFrame, prefix: str, prompts: Sequence[str] = tuple(V.METHOD_ALIASES)) -> DataFrame:
    """Split a served method into quantization tag and prompt, with column titles.

    The longest known prompt that ends the name wins; a title shared by several
    methods is told apart by the prompt.  ``column_order`` sorts the columns:
    baseline, then prompt number, tag and method.
    """
    by_length = sorted(prompts, key=lambda p: -len(p))
    rest = F.substr("method", F.lit(len(prefix) + 1))
    known = F.get(
        F.filter(F.array(*[F.lit(p) for p in by_length]), lambda p: rest.endswith(p)), F.lit(0)
    )
    return titled(split_served(df, prefix, known), prefix, method_alias(F.col("prompt")))


def split_served(df: DataFrame, prefix: str, known: Column) -> DataFrame:
    """Add ``quant`` and ``prompt``; ``known`` is the known prompt that a method ends with, else NULL."""
    served = F.col("method").startswith(prefix)
    rest = F.substr("method", F.lit(len(prefix) + 1))
    tag = F.rtrim(F.left(rest, F.length(rest) - F.length(known)), F.lit("_"))
    return df.withColumns(
        {
            "quant": F.when(~served, F.lit("")).otherwise(F.coalesce(tag, rest)),
            "prompt": F.when(~served, F.col("method")).otherwise(F.coalesce(known, rest)),
        }
    )


def titled(out: DataFrame, prefix: str, prompt_alias: Column) -> DataFrame:
    """Add ``title`` and ``column_order`` to methods split into ``quant`` and ``prompt``."""
    parts = F.filter(F.split(F.trim("quant"), "_"), lambda p: p != "")
    title = F.when(F.size(parts) > 0, F.concat_ws(
        "_", F.concat(F.upper(F.left(F.get(parts, F.lit(0)), F.lit(1))),
                      F.lower(F.substr(F.get(parts, F.lit(0)), F.lit(2)))),
        F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), F.lower),
    )).otherwise(F.trim("quant"))
    backend = V.BACKEND_TITLES.get(prefix, prefix.rstrip("_").title())
    out = out.withColumn(
        "_title",
        F.when(F.col("method") == V.BASELINE_METHOD, F.lit("Baseline"))
        .when(F.trim("quant") != "", title)
        .otherwise(F.concat(F.lit(f"{backend} · "), F.col("prompt"))),
    )
    shared = out.groupBy("_title").agg(F.count_distinct("method").alias("_n"))
    is_base = F.col("method") == V.BASELINE_METHOD
    order = F.struct(
        (~is_base).cast("int").alias("group"),
        F.when(is_base, 0).otherwise(alias_number(prompt_alias)).alias("number"),
        F.when(is_base, "").otherwise(F.col("quant")).alias("quant"),
        F.when(is_base, "").otherwise(F.col("method")).alias("method"),
    )
    return out.join(shared, "_title").withColumns(
        {
            "title": F.when(
                F.col("_n") > 1, F.concat(F.col("_title"), F.lit(" · "), F.col("prompt"))
            ).otherwise(F.col("_title")),
            "column_order": order,
        }
    ).drop("_title", "_n")
