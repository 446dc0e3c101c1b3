"""Small helpers on DataFrames shared by the operators."""
from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanmark.session import prepare


def prepared(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A query or stage, whose first argument is the session, with the session prepared."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args) -> DataFrame:
        return query(prepare(spark), *args)

    return run


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` does not have yet, also not in other letter case."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the value as text, modulo; null for null."""
    return F.crc32(F.col(column).cast("string")) % modulus


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def running_start(rows: DataFrame, key: str, bucket: str, order: list[str], value: str | None) -> DataFrame:
    """``rows`` with ``start``: the sum of ``value`` (or the number of rows) of the key's rows before, in the order
    of bucket and ``order``. ``rows`` is read twice and should be a written table."""
    amount = F.col(value) if value else F.lit(1).cast("long")
    totals = rows.groupBy(key, bucket).agg(F.sum(amount).alias("total"))
    over = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col(key).alias("o_key"), F.col(bucket).alias("o_bucket"),
                            F.coalesce(F.sum("total").over(over), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return (
        numbered.join(offsets, F.col(key).eqNullSafe(F.col("o_key")) & F.col(bucket).eqNullSafe(F.col("o_bucket")))
        .withColumn("start", F.col("inside") + F.col("offset")).drop("inside", "o_key", "o_bucket", "offset")
    )
