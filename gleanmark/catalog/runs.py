"""Queries for the run registry and the leaderboards."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanmark import vocabulary as V
from gleanmark.catalog.inputs import table
from gleanmark.operators import dimensions as DIM
from gleanmark.operators import leaderboard as LB
from gleanmark.operators import runs as R
from gleanmark.session import materialize


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("u", F.col("user_id").cast("string"))


def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _ids(spark, sf_dir).select(
        F.col("u").alias("model_key"), F.col("event_type").alias("method"), F.col("ts").alias("file_mtime"),
        F.col("event_id").alias("file_path"), "value",
    )
    return R.latest_runs(runs).select("model_key", "method", F.col("file_path").alias("event_id"), "value")


_LATEST_RUNS = """WITH r AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events
)
SELECT CAST(user_id AS VARCHAR) AS model_key, event_type AS method, event_id, value FROM r WHERE n = 1"""


def _run_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run documents, one per user and event type; ``error`` runs lie under another model's path."""
    return _ids(spark, sf_dir).groupBy(F.col("u").alias("model_key"), F.col("event_type").alias("method")).agg(
        F.round(F.avg("value"), 6).alias("f1_mass"), F.lit(None).cast("double").alias("f1_other"),
        F.round(F.avg((F.col("value") > 5).cast("int")), 6).alias("parsed_rate"),
        F.round(F.avg((F.col("value") > 10).cast("int")), 6).alias("raw_rate"),
        F.max("value").alias("average_response_time_seconds"), F.min("value").alias("gpu_memory_during_inference_gb"),
    ).withColumn("path_model", F.when(F.col("method") == "error", "other").otherwise(F.col("model_key")))


def flatten_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.flatten_runs(_run_table(spark, sf_dir))


_RUN_TABLE_CTE = """
g AS (
  SELECT CAST(user_id AS VARCHAR) AS model_key, event_type AS method, round(avg(value), 6) AS f1_mass,
    round(avg(CASE WHEN value > 5 THEN 1 ELSE 0 END), 6) AS parsed_rate,
    round(avg(CASE WHEN value > 10 THEN 1 ELSE 0 END), 6) AS raw_rate, max(value) AS latency, min(value) AS gpu
  FROM events GROUP BY ALL
)
"""
_FLATTEN_RUNS = f"""WITH {_RUN_TABLE_CTE}
SELECT model_key, method, metric, value FROM (
  SELECT model_key, method, 'f1_mass' AS metric, f1_mass AS value FROM g
  UNION ALL SELECT model_key, method, 'parsed_rate', parsed_rate FROM g
  UNION ALL SELECT model_key, method, 'raw_rate', raw_rate FROM g
  UNION ALL SELECT model_key, method, 'latency', latency FROM g
  UNION ALL SELECT model_key, method, 'gpu', gpu FROM g
) WHERE method <> 'error'"""


def validation_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run_table(spark, sf_dir).select(
        "model_key", "method", R.validation_cell(F.col("parsed_rate"), F.col("raw_rate")).alias("cell")
    )


_VALIDATION_CELLS = f"""WITH {_RUN_TABLE_CTE}
SELECT model_key, method, format('{{:.2f}}({{:.2f}})', parsed_rate, raw_rate) AS cell FROM g"""


def _quality_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells: source as model, language as method, mean label as value."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    labels = table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").groupBy(F.col("source").alias("model_key"), F.col("lang").alias("method")).agg(
        F.avg("quality").alias("value"), F.avg("toxic").alias("raw")
    )


_CELLS_CTE = """
c AS (
  SELECT source AS model_key, lang AS method, avg(quality) AS value, avg(toxic) AS raw
  FROM documents JOIN labels USING (doc_id) GROUP BY ALL
),
b AS (SELECT model_key, value AS base FROM c WHERE method = 'en'),
j AS (SELECT c.*, b.base FROM c LEFT JOIN b USING (model_key)),
f AS (
  SELECT *, abs(value) < 1e-6 AS empty,
    CASE WHEN abs(value) >= 1e-6 AND method <> 'en' THEN value - base END AS delta FROM j
)
"""


def leaderboard_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = LB.leaderboard(_quality_cells(spark, sf_dir).drop("raw"), "f1", baseline="en")
    return board.select(
        "model_key", "method", "alias", F.round("value", 6).alias("value"),
        F.coalesce(F.round("delta", 6).cast("string"), F.lit("-")).alias("delta"), "sign", "cell", "is_best",
    )


_LEADERBOARD_F1 = f"""WITH {_CELLS_CTE},
best AS (SELECT method, model_key AS bm FROM (
  SELECT *, row_number() OVER (PARTITION BY method ORDER BY value DESC, model_key) AS n FROM f WHERE NOT empty) WHERE n = 1)
SELECT model_key, method, upper(left(method, 1)) AS alias, round(value, 6) AS value,
  coalesce(CAST(round(delta, 6) AS VARCHAR), '-') AS delta, CAST(coalesce(sign(delta), 0) AS INT) AS sign,
  CASE WHEN empty THEN '-' ELSE format('{{:.4f}}', value) || coalesce(chr(10) || '(' || format('{{:+.2f}}', delta) || ')', '') END AS cell,
  coalesce(model_key = bm, false) AS is_best FROM f LEFT JOIN best USING (method)"""


def leaderboard_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = materialize(_quality_cells(spark, sf_dir), "cells")
    board = LB.leaderboard(cells, "validation", baseline="en")
    rounded = LB.leaderboard(cells, "validation", baseline="en", rounded=True)
    return board.select("model_key", "method", "cell", "sign").join(
        rounded.select("model_key", "method", F.coalesce(F.round("delta", 6), F.lit(9.0)).alias("rounded_delta")),
        ["model_key", "method"],
    )


_LEADERBOARD_VALIDATION = f"""WITH {_CELLS_CTE},
r AS (SELECT *, CAST(format('{{:.2f}}', value) AS DOUBLE) AS rv, CAST(format('{{:.2f}}', base) AS DOUBLE) AS rb FROM f)
SELECT model_key, method, format('{{:.2f}}', value) || chr(10) || '(' || format('{{:.2f}}', raw) || ')' AS cell,
  CASE WHEN abs(value - 1) < 1e-6 THEN 1 ELSE 0 END AS sign,
  coalesce(CASE WHEN method <> 'en' THEN round(rv - rb, 6) END, 9.0) AS rounded_delta FROM r"""


def _event_cells(spark: SparkSession, sf_dir: str, value: Column) -> DataFrame:
    return _ids(spark, sf_dir).groupBy(F.col("u").alias("model_key"), F.col("event_type").alias("method")).agg(
        value.alias("value")
    )


def leaderboard_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No method is named BASELINE, so the first by name is the baseline."""
    board = LB.leaderboard(_event_cells(spark, sf_dir, F.max("value")), "latency")
    return board.select(
        "model_key", "method", F.round("value", 6).alias("value"),
        F.coalesce(F.round("delta", 6), F.lit(-1e9)).alias("delta"), "sign", "is_best",
    )


_EVENT_BOARD = """WITH c AS (
  SELECT CAST(user_id AS VARCHAR) AS model_key, event_type AS method, {agg}(value) AS value FROM events GROUP BY ALL
),
f AS (
  SELECT c.*, {zero} AS empty, CASE WHEN c.method <> 'click' AND NOT ({zero}) THEN c.value - b.value END AS delta
  FROM c LEFT JOIN c b ON b.model_key = c.model_key AND b.method = 'click'
),
best AS (SELECT method, model_key AS bm FROM (
  SELECT *, row_number() OVER (PARTITION BY method ORDER BY value, model_key) AS n FROM f WHERE NOT empty) WHERE n = 1)
SELECT model_key, method, round(value, 6) AS value, coalesce(round(delta, 6), -1e9) AS delta,
  CAST(coalesce(sign(-delta), 0) AS INT) AS sign, {best} AS is_best FROM f LEFT JOIN best USING (method)"""
_LEADERBOARD_LATENCY = _EVENT_BOARD.format(agg="max", zero="abs(c.value) < 1e-6", best="coalesce(model_key = bm, false)")


def leaderboard_gpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero is a value here."""
    board = LB.leaderboard(_event_cells(spark, sf_dir, F.min("value")), "gpu")
    return board.select(
        "model_key", "method", F.round("value", 6).alias("value"),
        F.coalesce(F.round("delta", 6), F.lit(-1e9)).alias("delta"), "sign", "is_best",
    )


_LEADERBOARD_GPU = _EVENT_BOARD.format(agg="min", zero="false", best="false")


def best_per_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = LB.best_per_method(_quality_cells(spark, sf_dir).filter(F.col("value") >= 1e-6))
    return best.withColumn("value", F.round("value", 6))


_BEST_PER_METHOD = f"""WITH {_CELLS_CTE}
SELECT method, model_key, round(value, 6) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY method ORDER BY value DESC, model_key) AS n FROM f WHERE NOT empty) WHERE n = 1"""


def avg_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = LB.leaderboard(_quality_cells(spark, sf_dir).drop("raw"), "f1", baseline="en")
    return LB.avg_delta(board, "f1").select(
        "method", F.coalesce(F.round("avg_delta", 6), F.lit(9.0)).alias("avg_delta"), "sign"
    )


_AVG_DELTA = f"""WITH {_CELLS_CTE},
a AS (SELECT method, avg(delta) FILTER (WHERE abs(base) >= 1e-6) AS d FROM f GROUP BY method)
SELECT method, coalesce(round(d, 6), 9.0) AS avg_delta, CAST(coalesce(sign(d), 0) AS INT) AS sign FROM a"""


def avg_delta_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = LB.leaderboard(_quality_cells(spark, sf_dir), "validation", baseline="en")
    return LB.avg_delta(board, "validation").select("method", F.coalesce(F.round("avg_delta", 6), F.lit(9.0)).alias("avg_delta"), "sign")


_AVG_DELTA_VALIDATION = f"""WITH {_CELLS_CTE},
a AS (SELECT method, avg(CASE WHEN method <> 'en' THEN value - base END) AS d FROM f GROUP BY method)
SELECT method, coalesce(round(d, 6), 9.0) AS avg_delta, CAST(coalesce(sign(d), 0) AS INT) AS sign FROM a"""


def _avg_event_delta(spark: SparkSession, sf_dir: str, value: Column, metric: str) -> DataFrame:
    board = LB.leaderboard(_event_cells(spark, sf_dir, value), metric, baseline="click")
    return LB.avg_delta(board, metric).select("method", F.coalesce(F.round("avg_delta", 6), F.lit(-1e9)).alias("avg_delta"), "sign")


def avg_delta_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _avg_event_delta(spark, sf_dir, F.max("value"), "latency")


def avg_delta_gpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _avg_event_delta(spark, sf_dir, F.min("value"), "gpu")


_AVG_EVENT_DELTA = """WITH c AS (
  SELECT CAST(user_id AS VARCHAR) AS model_key, event_type AS method, {agg}(value) AS value FROM events GROUP BY ALL
),
f AS (
  SELECT c.method, CASE WHEN c.method <> 'click' AND NOT ({zero}) AND NOT ({base_zero}) THEN c.value - b.value END AS delta
  FROM c LEFT JOIN c b ON b.model_key = c.model_key AND b.method = 'click'
),
a AS (SELECT method, avg(delta) AS d FROM f GROUP BY method)
SELECT method, coalesce(round(d, 6), -1e9) AS avg_delta, CAST(coalesce(sign(-d), 0) AS INT) AS sign FROM a"""


def leaderboard_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = LB.leaderboard(_quality_cells(spark, sf_dir).drop("raw"), "f1", baseline="en")
    return LB.matrix(board, ["de", "en", "es", "fr"])


_LEADERBOARD_MATRIX = f"""WITH {_CELLS_CTE},
t AS (SELECT model_key, method, CASE WHEN empty THEN '-' ELSE format('{{:.4f}}', value) ||
  coalesce(chr(10) || '(' || format('{{:+.2f}}', delta) || ')', '') END AS cell FROM f)
SELECT model_key, {', '.join(f"coalesce(max(cell) FILTER (WHERE method = '{m}'), '-') AS {m}" for m in ('de', 'en', 'es', 'fr'))}
FROM t GROUP BY model_key"""


def method_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of known methods, initials of others."""
    name = F.when(F.col("p_size") > 25, F.lit("DETAILED_INSTR_ONESHOT")).otherwise(
        F.concat(F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))), F.lit("__X"))
    )
    return LB.with_alias(table(spark, sf_dir, "part").select("p_partkey", name.alias("method"))).select(
        "p_partkey", "alias", "method_order"
    )


_METHOD_ALIAS = """SELECT p_partkey, CASE WHEN p_size > 25 THEN '2.DIO' ELSE
  upper(left(p_name, 1)) || upper(left(string_split(p_name, ' ')[2], 1)) || 'X' END AS alias,
  CASE WHEN p_size > 25 THEN 2 ELSE 9999 END AS method_order FROM part"""

_METHOD_OF_EVENT = {
    "click": "OLLAMA_Q4_K_M_DETAILED_INSTR_ONESHOT", "view": V.BASELINE_METHOD,
    "signup": "VLLM_DETAILED_INSTR_ONESHOT", "error": "OLLAMA_q8_0_MINIMAL_INSTR_FIVESHOT_CD_RUS_OUTLINES",
    "purchase": "OLLAMA_Q4_K_M_MINIMAL_INSTR_FIVESHOT",
}


def _served_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose method depends on the event type, with a value range as model."""
    method = F.lit(None).cast("string")
    for kind, name in _METHOD_OF_EVENT.items():
        method = F.when(F.col("event_type") == kind, name).otherwise(method)
    model = F.concat(F.col("u"), F.lit("-"), F.floor(F.col("value") / 10).cast("string"))
    return _ids(spark, sf_dir).groupBy(model.alias("model_key"), method.alias("method")).agg(
        F.max("value").alias("value")
    )


_SERVED_CTE = f"""
s AS (
  SELECT CAST(user_id AS VARCHAR) || '-' || CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) AS model_key,
    CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _METHOD_OF_EVENT.items())} END AS method, max(value) AS value
  FROM events GROUP BY ALL
)
"""


def main_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LB.main_methods(_served_cells(spark, sf_dir))


def backend_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LB.backend_slice(_served_cells(spark, sf_dir), "OLLAMA_")


_BACKEND_SLICE = f"""WITH {_SERVED_CTE}
SELECT * FROM s WHERE starts_with(method, 'OLLAMA_') OR (method = '{V.BASELINE_METHOD}'
  AND model_key IN (SELECT model_key FROM s WHERE starts_with(method, 'OLLAMA_')))"""


def split_quant(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = LB.backend_slice(_served_cells(spark, sf_dir), "OLLAMA_")
    return LB.split_quant(cells, "OLLAMA_").select(
        "model_key", "method", "quant", "prompt", "title", F.col("column_order.number").alias("number")
    )


_SPLIT_QUANT = f"""WITH {_SERVED_CTE}, b AS ({_BACKEND_SLICE.split(_SERVED_CTE)[1].strip()})
SELECT model_key, method,
  CASE WHEN method LIKE 'OLLAMA_Q4%' THEN 'Q4_K_M' WHEN method LIKE 'OLLAMA_q8%' THEN 'q8_0' ELSE '' END AS quant,
  regexp_replace(method, '^OLLAMA_(Q4_K_M|q8_0)_', '') AS prompt,
  CASE WHEN method LIKE 'OLLAMA_Q4%' THEN 'Q4_k_m · ' || regexp_replace(method, '^OLLAMA_Q4_K_M_', '')
    WHEN method LIKE 'OLLAMA_q8%' THEN 'Q8_0' ELSE 'Baseline' END AS title,
  CASE WHEN method LIKE '%ONESHOT' THEN 2 WHEN method LIKE '%FIVESHOT' THEN 3 WHEN method LIKE '%OUTLINES' THEN 6 ELSE 0 END AS number
FROM b"""


def _prompt_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with numbered titles, one or two per order; the longer ones end with shorter ones."""
    key, title = F.col("o_orderkey"), F.concat(F.col("o_custkey").cast("string"), F.lit(".T"))
    short = F.struct(F.concat(F.lit("P"), key, F.lit("_SHOT")).alias("method"), title.alias("alias"))
    long = F.when(key % 3 == 0, F.struct(F.concat(F.lit("LONG_P"), key, F.lit("_SHOT")).alias("method"), F.lit("7.L").alias("alias")))
    return table(spark, sf_dir, "orders").select(F.inline(F.array_compact(F.array(short, long))))


def split_quant_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Served methods split by a dimension of more than ten thousand prompts."""
    key = F.col("o_orderkey")
    quant = F.when(key % 4 == 0, "Q4_K_M_").when(key % 4 == 1, "q8_0_").when(key % 4 == 2, "").otherwise("fp16_")
    prompt = F.when(key % 10 == 9, F.concat(F.lit("UNKNOWN"), key)).when(
        key % 6 < 3, F.concat(F.lit("LONG_P"), key, F.lit("_SHOT"))).otherwise(F.concat(F.lit("P"), key, F.lit("_SHOT")))
    methods = table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("model_key"), F.concat(F.lit("OLLAMA_"), quant, prompt).alias("method"))
    return DIM.split_quant(methods, "OLLAMA_", _prompt_dimension(spark, sf_dir)).select(
        "model_key", "method", "quant", "prompt", "title", F.col("column_order.number").alias("number"))


_SPLIT_QUANT_DIM = """WITH dim AS (
  SELECT 'P' || o_orderkey || '_SHOT' AS prompt, CAST(o_custkey AS INT) AS number FROM orders
  UNION ALL SELECT 'LONG_P' || o_orderkey || '_SHOT', 7 FROM orders WHERE o_orderkey % 3 = 0
), m AS (
  SELECT o_orderstatus AS model_key, CASE o_orderkey % 4 WHEN 0 THEN 'Q4_K_M_' WHEN 1 THEN 'q8_0_' WHEN 2 THEN '' ELSE 'fp16_' END ||
    CASE WHEN o_orderkey % 10 = 9 THEN 'UNKNOWN' || o_orderkey WHEN o_orderkey % 6 < 3 THEN 'LONG_P' || o_orderkey || '_SHOT'
    ELSE 'P' || o_orderkey || '_SHOT' END AS rest FROM orders
), s AS (
  SELECT DISTINCT rest, substr(rest, i) AS ending FROM (SELECT rest, unnest(range(1, length(rest) + 1)) AS i FROM m)
), f AS (
  SELECT rest, arg_max(prompt, length(prompt)) AS prompt, arg_max(number, length(prompt)) AS number
  FROM s JOIN dim ON ending = prompt GROUP BY rest
), q AS (
  SELECT model_key, m.rest, coalesce(f.prompt, m.rest) AS prompt, coalesce(f.number, 9999) AS number,
         CASE WHEN f.prompt IS NULL THEN m.rest ELSE rtrim(left(m.rest, length(m.rest) - length(f.prompt)), '_') END AS quant
  FROM m LEFT JOIN f USING (rest)
), t AS (
  SELECT *, CASE WHEN quant = '' THEN 'Ollama · ' || prompt ELSE upper(left(quant, 1)) || lower(substr(quant, 2)) END AS base FROM q
)
SELECT model_key, 'OLLAMA_' || rest AS method, quant, prompt,
  CASE WHEN count(DISTINCT rest) OVER (PARTITION BY base) > 1 THEN base || ' · ' || prompt ELSE base END AS title, number FROM t"""


def method_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and descriptions of the methods of all cells from the dimension."""
    return DIM.with_alias(_served_cells(spark, sf_dir), DIM.method_dimension(spark)).select(
        "model_key", "method", "alias", "description", "method_order")


_METHOD_DIMENSION = f"""WITH {_SERVED_CTE}, d(method, alias, description) AS (VALUES {", ".join(
    "('" + "', '".join((m, a, V.METHOD_DESCRIPTIONS[m])) + "')" for m, a in V.METHOD_ALIASES.items())})
SELECT model_key, s.method, coalesce(alias, list_reduce(list_transform(string_split(s.method, '_'), lambda p: upper(left(p, 1))), lambda a, b: a || b)) AS alias,
  coalesce(description, s.method) AS description,
  coalesce(CAST(regexp_extract(alias, '^([0-9]+)[.]', 1) AS INT), 9999) AS method_order FROM s LEFT JOIN d USING (method)"""


def derive_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run attributes from events: each type names, decodes and serves differently."""
    kind, value, u = F.col("event_type"), F.col("value"), F.col("u")
    rows = _ids(spark, sf_dir).select(
        "event_id",
        F.when(kind == "click", F.concat(F.lit("m "), u, F.lit("-ollama"))).when(
            kind == "view", F.concat(F.lit("m/"), u, F.lit("_20260203_2127"))
        ).when(kind == "signup", F.concat(F.lit("m"), u, F.lit("-vllm"))).alias("model_key"),
        F.when(kind == "click", F.lit("x:8b-q4_K_M")).when(kind == "error", F.concat(F.lit("org/Name"), u, F.lit("_it")))
        .otherwise(F.concat(F.lit("Model"), u, F.lit("_20260203"))).alias("model_name"),
        F.concat(F.lit("PROMPT "), F.floor(value / 10).cast("string")).alias("prompt_template"),
        F.when(kind == "purchase", "critic_3agents").when(kind == "error", "simple 4agents").alias("agent_mode"),
        F.when(value > 30, F.lit("P:1")).alias("prompt_name"),
        (value > 50).alias("structured"), (value > 60).alias("outlines"), (value > 70).alias("guidance"),
        (kind == "click").alias("ollama"), (kind == "signup").alias("vllm"),
    )
    return R.derive_method(rows).select("event_id", "run_model", "method")


_DERIVE_METHOD = """WITH e AS (
  SELECT event_id, event_type AS t, CAST(user_id AS VARCHAR) AS u, value,
    CASE WHEN event_type = 'purchase' THEN 'MA_CRITIC_3AGENTS' || CASE WHEN value > 30 THEN '_P_1' ELSE '' END
      WHEN event_type = 'error' THEN 'MA_SIMPLE_4AGENTS'
      ELSE 'PROMPT_' || CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) END ||
    CASE WHEN value > 70 THEN '_GUIDANCE' WHEN value > 60 THEN '_OUTLINES' WHEN value > 50 THEN '_STRUCTURED' ELSE '' END AS base
  FROM events
)
SELECT event_id, CASE t WHEN 'click' THEN 'm_' || u WHEN 'view' THEN 'm_' || u WHEN 'signup' THEN 'm' || u
  WHEN 'error' THEN 'Name' || u ELSE 'Model' || u END AS run_model,
  CASE t WHEN 'click' THEN 'OLLAMA_Q4_K_M_' WHEN 'signup' THEN 'VLLM_' ELSE '' END || base AS method FROM e"""


def name_from_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    name = (
        F.when(kind == "click", F.concat(F.lit("results_m"), F.col("u"), F.lit("_20260203_2127.csv")))
        .when(kind == "view", F.concat(F.lit("results_m_"), F.col("u"), F.lit("_2127.csv")))
        .when(kind == "signup", F.lit("results_2127.csv")).otherwise(F.concat(F.lit("results_m"), F.col("u"), F.lit(".csv")))
    )
    return _ids(spark, sf_dir).select("event_id", R.name_from_file(name).alias("model_name"))


_NAME_FROM_FILE = """SELECT event_id, CASE event_type WHEN 'view' THEN 'm_' || CAST(user_id AS VARCHAR)
  WHEN 'signup' THEN '2127' ELSE 'm' || CAST(user_id AS VARCHAR) END AS model_name FROM events"""


def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ids(spark, sf_dir).select(
        F.col("event_type").alias("run_id"), (F.col("value") > 5).alias("is_valid"), F.col("value").alias("elapsed_s"),
        F.col("user_id").cast("double").alias("gpu_gb"),
    )
    out = R.run_counters(rows)
    counts = ("total_samples", "valid_json_count", "invalid_json_count")
    return out.select("run_id", *counts, *[F.round(c, 6).alias(c) for c in out.columns if c not in ("run_id", *counts)])


_RUN_COUNTERS = """SELECT event_type AS run_id, count(*) AS total_samples, count(*) FILTER (WHERE value > 5) AS valid_json_count,
  count(*) FILTER (WHERE NOT value > 5) AS invalid_json_count,
  round(count(*) FILTER (WHERE NOT value > 5) / count(*), 6) AS parsing_error_rate,
  round(avg(value), 6) AS average_response_time_seconds, round(min(value), 6) AS min_response_time_seconds,
  round(max(value), 6) AS max_response_time_seconds, round(sum(value), 6) AS total_inference_seconds,
  round(avg(user_id), 6) AS gpu_memory_during_inference_gb FROM events GROUP BY 1"""


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    status = R.outcome_status(
        F.when(kind == "error", "error").when(kind == "signup", "interrupted"), kind.isin("click", "view"),
        F.when(kind == "click", F.lit("mean over limit")),
    )
    return _ids(spark, sf_dir).select(
        "event_id", F.col("u").alias("model_key"), status.alias("status"), F.col("props").alias("message"),
        value.alias("avg_speed"), (value / 1000).alias("parsing_error_rate"), (value / 10).alias("memory_gb"),
        F.when(value > 10, "critic_3agents").alias("agent_mode"),
    )


def outcome_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.outcome_summary(_outcomes(spark, sf_dir))
    return out.select("status", "models", *[F.round(c, 6).alias(c) for c in ("avg_speed", "parsing_error_rate", "memory_gb")])


_STATUS = "CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'timeout' WHEN 'purchase' THEN 'success' ELSE 'interrupted' END"
_OUTCOME_SUMMARY = f"""SELECT {_STATUS} AS status, count(*) AS models, round(avg(value), 6) AS avg_speed,
  round(avg(value / 1000), 6) AS parsing_error_rate, round(avg(value / 10), 6) AS memory_gb FROM events GROUP BY 1"""


def outcome_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.outcome_lines(_outcomes(spark, sf_dir))


_OUTCOME_LINES = f"""SELECT {_STATUS} AS status, CAST(user_id AS VARCHAR) AS model_key, CASE WHEN event_type = 'purchase'
  THEN CASE WHEN value > 10 THEN 'critic_3agents' ELSE 'single' END || '; ' || format('{{:.3f}}', value) || ' s; '
    || format('{{:.2f}}', value / 1000 * 100) || '%; ' || format('{{:.2f}}', value / 10) || ' GB' ELSE props END AS line FROM events"""


QUERIES = {
    "latest_runs": (latest_runs, _LATEST_RUNS),
    "flatten_runs": (flatten_runs, _FLATTEN_RUNS),
    "validation_cells": (validation_cells, _VALIDATION_CELLS),
    "leaderboard_f1": (leaderboard_f1, _LEADERBOARD_F1),
    "leaderboard_validation": (leaderboard_validation, _LEADERBOARD_VALIDATION),
    "leaderboard_latency": (leaderboard_latency, _LEADERBOARD_LATENCY),
    "leaderboard_gpu": (leaderboard_gpu, _LEADERBOARD_GPU),
    "leaderboard_matrix": (leaderboard_matrix, _LEADERBOARD_MATRIX),
    "best_per_method": (best_per_method, _BEST_PER_METHOD),
    "avg_delta": (avg_delta, _AVG_DELTA),
    "avg_delta_validation": (avg_delta_validation, _AVG_DELTA_VALIDATION),
    "avg_delta_latency": (avg_delta_latency, _AVG_EVENT_DELTA.format(
        agg="max", zero="abs(c.value) < 1e-6", base_zero="coalesce(abs(b.value), 0) < 1e-6")),
    "avg_delta_gpu": (avg_delta_gpu, _AVG_EVENT_DELTA.format(agg="min", zero="false", base_zero="false")),
    "method_alias": (method_alias, _METHOD_ALIAS),
    "main_methods": (main_methods, f"WITH {_SERVED_CTE} SELECT * FROM s WHERE method = '{V.BASELINE_METHOD}'"),
    "backend_slice": (backend_slice, _BACKEND_SLICE),
    "split_quant": (split_quant, _SPLIT_QUANT),
    "split_quant_dim": (split_quant_dim, _SPLIT_QUANT_DIM),
    "method_dimension": (method_dimension, _METHOD_DIMENSION),
    "derive_method": (derive_method, _DERIVE_METHOD),
    "name_from_file": (name_from_file, _NAME_FROM_FILE),
    "run_counters": (run_counters, _RUN_COUNTERS),
    "outcome_summary": (outcome_summary, _OUTCOME_SUMMARY),
    "outcome_lines": (outcome_lines, _OUTCOME_LINES),
}
