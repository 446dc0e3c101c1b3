"""Inputs shared by the registered queries, derived from the provided tables.

The tables hold no model responses, so truth, predictions and responses are
derived row by row from their columns, by rules SQL can repeat.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanmark.operators.entries import PREDICTED, TRUTH, number_entries
from gleanmark.plans.spread import TASK_ROWS, spread  # noqa: F401
from gleanmark.session import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def percent(col: str) -> Column:
    return F.round(F.col(col) * 100).cast("int")


def line_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth: one entry per line of an order.  Prediction: the same, with low
    discounts left out, discount 5 off by one and discount 7 given twice."""
    lines = spread(table(spark, sf_dir, "lineitem")).select(
        F.col("l_linestatus").alias("run_id"), F.col("l_orderkey").alias("text_index"),
        "l_returnflag", "l_quantity", "l_linenumber", "l_partkey", "l_suppkey",
        percent("l_discount").alias("d"), percent("l_tax").alias("x"),
    )
    order = (
        (F.col("l_linenumber").cast("bigint") * 1000000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")
    ) * 100 + F.col("l_quantity").cast("bigint")
    entry = lambda side, value, copy: F.struct(
        F.lit(side).alias("side"), value.alias("number"), (order * 2 + copy).alias("pos")
    )
    predicted = F.col("l_quantity") + F.when(F.col("d") == 5, 1).otherwise(0)
    # One pass over the lines: each gives its true entry and up to two predictions.
    rows = lines.withColumn("grp", F.when(F.col("x") < 4, "mass").otherwise("other")).select(
        "run_id", "text_index", "grp", F.col("l_returnflag").alias("key"),
        F.inline(F.array_compact(F.array(
            entry(TRUTH, F.col("l_quantity"), 0),
            F.when(F.col("d") > 1, entry(PREDICTED, predicted, 0)),
            F.when(F.col("d") == 7, entry(PREDICTED, predicted, 1)),
        ))),
    )
    unit = F.when(F.col("grp") == "other", F.lit("кг"))
    return number_entries(rows, F.col("key"), F.col("number"), unit, ["run_id", "text_index"])


# The same entries in SQL; ``side`` 0 is predicted, 1 true.
LINE_ENTRIES_SQL = """
lines AS (
  SELECT l_linestatus AS run_id, l_orderkey AS text_index, l_returnflag AS key, l_quantity AS q,
         CAST(round(l_discount * 100) AS INT) AS d,
         CASE WHEN CAST(round(l_tax * 100) AS INT) < 4 THEN 'mass' ELSE 'other' END AS grp,
         CASE WHEN CAST(round(l_tax * 100) AS INT) < 4 THEN '' ELSE 'кг' END AS unit,
         ((CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey) * 10000 + l_suppkey) * 100
           + CAST(l_quantity AS BIGINT) AS o
  FROM lineitem
),
entries AS (
  SELECT run_id, text_index, grp, key, unit, q AS value, 1 AS side, o * 2 AS pos FROM lines
  UNION ALL
  SELECT run_id, text_index, grp, key, unit, q + CASE WHEN d = 5 THEN 1 ELSE 0 END, 0, o * 2
  FROM lines WHERE d > 1
  UNION ALL
  SELECT run_id, text_index, grp, key, unit, q + CASE WHEN d = 5 THEN 1 ELSE 0 END, 0, o * 2 + 1
  FROM lines WHERE d = 7
),
counted AS (
  SELECT run_id, text_index, grp, key, value,
         count(*) FILTER (WHERE side = 0) AS np, count(*) FILTER (WHERE side = 1) AS nt
  FROM entries GROUP BY ALL
),
per_key AS (
  SELECT run_id, text_index, grp, key, sum(least(np, nt)) AS tp, sum(np - least(np, nt)) AS fp,
         sum(nt - least(np, nt)) AS open_true
  FROM counted GROUP BY ALL
),
per_text AS (
  SELECT run_id, text_index, grp, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp,
         CAST(sum(CASE WHEN fp = 0 THEN open_true ELSE 0 END) AS BIGINT) AS fn
  FROM per_key GROUP BY ALL
)
"""


def order_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus and responses from orders: run_id, text_index, text, truth_json, raw_output.

    Priority decides the response: plain JSON, a fenced one with a wrong
    value, a truncated one, prose, or one with latin keys.
    """
    o = table(spark, sf_dir, "orders")
    amount = F.floor("o_totalprice").cast("bigint").cast("string")
    cust, status = F.col("o_custkey").cast("string"), F.col("o_orderstatus")

    def record(fraction: Column, keys: tuple[str, ...]) -> Column:
        mass, other, sub, frac, par, weight, unit, val = keys
        return F.concat(
            F.lit(f'{{"{mass}": [{{"{sub}": "N", "{frac}": '), fraction,
            F.lit(f'}}, {{"{sub}": "К2О", "{frac}": "'), cust,
            F.lit(f'%"}}], "{other}": [{{"{par}": "масса", "{weight}": '), cust,
            F.lit(f', "{unit}": "кг"}}, {{"{par}": "статус", "{val}": "'), status, F.lit('"}]}'),
        )

    cyrillic = ("массовая доля", "прочее", "вещество", "массовая доля", "параметр", "масса", "единица", "значение")
    latin = ("mass_fractions", "other_params", "substance_name", "mass_fraction", "parameter_name", "mass", "unit", "value")
    truth = record(amount, cyrillic)
    plus_one = (F.floor("o_totalprice").cast("bigint") + 1).cast("string")
    level = F.left("o_orderpriority", F.lit(1))
    raw = (
        F.when(level == "1", truth)
        .when(level == "2", F.concat(F.lit("Вот ответ.\n```json\n"), record(plus_one, cyrillic), F.lit("\n```\nГотово.")))
        .when(level == "3", F.concat(F.lit("ОТВЕТ: "), F.left(truth, F.length(truth) - 1)))
        .when(level == "4", F.concat(F.lit("данных нет "), cust))
        .otherwise(record(amount, latin))
    )
    return o.select(
        status.alias("run_id"), F.col("o_orderkey").alias("text_index"),
        F.concat(F.lit("заказ "), F.col("o_orderkey").cast("string")).alias("text"),
        truth.alias("truth_json"), raw.alias("raw_output"),
        F.col("o_totalprice").alias("elapsed_s"), F.lit(1.0).alias("gpu_gb"),
    )
