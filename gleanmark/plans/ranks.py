"""Running totals and order statistics that never put a whole group in one task.

A window over ``PARTITION BY key`` sends all rows of a key to one task.  Running
totals put the rows into ranges instead, and order statistics narrow a
histogram block by block; totals per range or block are aggregated with
map-side combine, and only the rows of one range meet in a window.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanmark.session import materialize


def running_total(
    df: DataFrame, keys: Sequence[str], order: str, name: str, value: Column | None = None
) -> DataFrame:
    """Add ``name``: the sum of ``value`` (default: rows) up to and including the row."""
    return running_totals(df, keys, order, {name: F.lit(1) if value is None else value})


def running_totals(df: DataFrame, keys: Sequence[str], order: str, values: dict[str, Column]) -> DataFrame:
    """Add a column for every one of ``values``: its sum up to and including the row, as a whole number.

    ``order`` is unique within ``keys``.  Rows are put into ranges of (keys,
    order) of about equal numbers of rows, however dense the values are, and
    written once; a window holds one range, and the totals of a key, one row
    for each of its ranges, give the offsets.
    """
    keys = list(keys)
    amounts = {f"_amount_{name}": value.cast("bigint") for name, value in values.items()}
    ranged = df.withColumns(amounts).repartitionByRange(*keys, order)
    rows = materialize(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    totals = rows.groupBy(*keys, "_range").agg(*[F.sum(f"_amount_{n}").alias(f"_total_{n}") for n in values])
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_range", *[F.coalesce(F.sum(f"_total_{n}").over(before), F.lit(0)).alias(f"_offset_{n}") for n in values])
    upto = (
        Window.partitionBy(*keys, "_range").orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        null_safe_join(rows, offsets, [*keys, "_range"])
        .withColumns({n: F.sum(f"_amount_{n}").over(upto) + F.col(f"_offset_{n}") for n in values})
        .drop("_range", *amounts, *[f"_offset_{n}" for n in values])
    )


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that treats NULL keys as equal, keeping the left key columns once."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in on})
    condition = F.lit(True)
    for k in on:
        condition = condition & left[k].eqNullSafe(renamed[f"_r_{k}"])
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in on])


def values_at_ranks(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: dict[str, Column],
    weight: str | None = None,
    shifts: Sequence[int] = (16, 0),
) -> DataFrame:
    """The ``value`` at given 1-based ranks within each group, exactly.

    ``ranks`` maps an output column to an expression over ``n`` (rows in the
    group).  ``value`` is a non-negative integer.  Rows are first reduced to a
    histogram; then each level keeps only the block that holds the rank, so a
    task sees at most as many rows as a level has blocks.
    """
    keys = list(keys)
    count = F.sum(weight) if weight else F.count(F.lit(1))
    histogram = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(count.alias("_n"))
    size = histogram.groupBy(*keys).agg(F.sum("_n").alias("n"))
    wanted = size.select(
        *keys, "n",
        F.explode(
            F.array(*[
                F.struct(F.lit(name).alias("_name"), rank.cast("bigint").alias("_rank"))
                for name, rank in ranks.items()
            ])
        ).alias("_w"),
    ).select(*keys, "n", "_w.*")
    # One row per (group, wanted rank), narrowed level by level.
    picks = wanted.withColumn("_low", F.lit(None).cast("bigint"))
    previous = None
    for shift in shifts:
        block = F.shiftright(F.col(value).cast("bigint"), shift)
        level = histogram.withColumn("_block", block)
        if previous is None:
            level = level.withColumn("_parent", F.lit(0).cast("bigint"))
            picks = picks.withColumn("_low", F.lit(0).cast("bigint"))
        else:
            parent = F.shiftright(F.col(value).cast("bigint"), previous)
            level = level.withColumn("_parent", parent)
            level = null_safe_join(
                level, picks.select(*keys, F.col("_low").alias("_parent")).distinct(),
                [*keys, "_parent"], "left_semi",
            )
        sums = level.groupBy(*keys, "_parent", "_block").agg(F.sum("_n").alias("_n"))
        upto = (
            Window.partitionBy(*keys, "_parent").orderBy("_block")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        sums = sums.withColumn("_upto", F.sum("_n").over(upto)).withColumnRenamed("_parent", "_low")
        joined = null_safe_join(picks, sums, [*keys, "_low"])
        inside = (F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_n"))
        picks = joined.filter(inside).select(
            *keys, "n", "_name",
            (F.col("_rank") - (F.col("_upto") - F.col("_n"))).alias("_rank"),
            F.col("_block").alias("_low"),
        )
        previous = shift
    return picks.groupBy(*keys, "n").agg(
        *[F.max(F.when(F.col("_name") == name, F.col("_low"))).alias(name) for name in ranks]
    )
