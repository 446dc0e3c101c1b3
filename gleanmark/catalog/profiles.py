"""Queries for length and token profiles."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanmark import vocabulary as V
from gleanmark.catalog.inputs import order_texts, spread, table
from gleanmark.functions import text as TX
from gleanmark.operators import dimensions as DIM
from gleanmark.operators import lengths as L

# Context limits of the models the queries ask about.
_LIMITS = {"en": 32768, "de": 8192, "fr": 2048}


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


def expand_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", F.md5(TX.expand_escapes(F.col("html"))).alias("expanded")
    )


_EXPAND_ESCAPES = r"""SELECT page_id, md5(replace(replace(replace(replace(html, '\', '\\'), chr(10), '\n'), chr(13), '\r'),
  chr(9), '\t')) AS expanded FROM pages"""


def answer_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference answers laid out as indented JSON; prose stays as it is."""
    rows = spread(order_texts(spark, sf_dir))
    level = F.when(F.col("raw_output").startswith("данных"), F.col("raw_output")).otherwise(F.col("truth_json"))
    rows = L.answer_text(rows.withColumn("answer", level), "answer", "laid_out")
    return rows.select("text_index", F.md5("laid_out").alias("answer"), F.length("laid_out").alias("chars"))


_ANSWER_TEXT = """WITH o AS (
  SELECT o_orderkey AS text_index, CAST(o_custkey AS VARCHAR) AS c, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS a,
         o_orderstatus AS s, o_orderpriority AS p, chr(10) AS n FROM orders
),
t AS (
  SELECT text_index, CASE WHEN p LIKE '4%' THEN 'данных нет ' || c ELSE
    '{' || n || '  "массовая доля": [' || n || '    {' || n || '      "вещество": "N",' || n || '      "массовая доля": ' || a || n
    || '    },' || n || '    {' || n || '      "вещество": "К2О",' || n || '      "массовая доля": "' || c || '%"' || n || '    }' || n
    || '  ],' || n || '  "прочее": [' || n || '    {' || n || '      "параметр": "масса",' || n || '      "масса": ' || c || ',' || n
    || '      "единица": "кг"' || n || '    },' || n || '    {' || n || '      "параметр": "статус",' || n
    || '      "значение": "' || s || '"' || n || '    }' || n || '  ]' || n || '}' END AS x FROM o
)
SELECT text_index, md5(x) AS answer, CAST(length(x) AS INT) AS chars FROM t"""

_TOKENS = r"len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'))"
_ESCAPED = r"replace(replace(replace(replace(text, '\', '\\'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t')"

_PROFILE_CTE = f"""
t AS (SELECT lang, CAST({_TOKENS.format(_ESCAPED)} AS BIGINT) AS len FROM documents),
r AS (
  SELECT lang, len, row_number() OVER (PARTITION BY lang ORDER BY len) AS rk, count(*) OVER (PARTITION BY lang) AS n
  FROM t WHERE len > 0
),
p AS (
  SELECT lang, max(n) AS n, min(len) AS min_len, max(len) AS max_len, avg(len) AS mean_len,
    max(len) FILTER (WHERE rk = CASE WHEN floor(n * 0.9::DOUBLE) = 0 THEN n ELSE floor(n * 0.9::DOUBLE) END) AS p90,
    max(len) FILTER (WHERE rk = CASE WHEN floor(n * 0.95::DOUBLE) = 0 THEN n ELSE floor(n * 0.95::DOUBLE) END) AS p95,
    max(len) FILTER (WHERE rk = CASE WHEN floor(n * 0.99::DOUBLE) = 0 THEN n ELSE floor(n * 0.99::DOUBLE) END) AS p99
  FROM r GROUP BY lang
)
"""


def length_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.length_profile(_docs(spark, sf_dir), "text", by=["lang"]).withColumn(
        "mean_len", F.round("mean_len", 6)
    )


_LENGTH_PROFILE = f"""WITH {_PROFILE_CTE}
SELECT lang, n, min_len, max_len, round(mean_len, 6) AS mean_len, p90, p95, p99 FROM p"""


def budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = L.length_profile(_docs(spark, sf_dir), "text", by=["lang"])
    return profile.select("lang", L.recommend_budget(F.col("max_len")).alias("budget"))


_BUDGET = f"""WITH {_PROFILE_CTE},
b AS (SELECT lang, greatest(max_len + CAST(floor(max_len * 0.15::DOUBLE) AS BIGINT), 256) AS x FROM p)
SELECT lang, CAST(ceil(x / 64.0) * 64 AS BIGINT) AS budget FROM b"""


def length_profile_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One profile over all pages, counted in characters."""
    chars = lambda c: F.length(c)
    return L.length_profile(table(spark, sf_dir, "pages"), "html", counter=chars).select(
        "n", "min_len", "max_len", "p90", "p95", "p99"
    )


_LENGTH_PROFILE_ALL = f"""WITH t AS (SELECT CAST(length({_ESCAPED.replace('text', 'html')}) AS BIGINT) AS len FROM pages),
r AS (SELECT len, row_number() OVER (ORDER BY len) AS rk, count(*) OVER () AS n FROM t WHERE len > 0)
SELECT max(n) AS n, min(len) AS min_len, max(len) AS max_len,
  max(len) FILTER (WHERE rk = floor(n * 0.9::DOUBLE)) AS p90, max(len) FILTER (WHERE rk = floor(n * 0.95::DOUBLE)) AS p95,
  max(len) FILTER (WHERE rk = floor(n * 0.99::DOUBLE)) AS p99 FROM r"""


def longest_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).withColumn("prompt", F.concat(F.lit("Извлеки факты: "), F.col("text")))
    out = L.longest_example(docs, "prompt", "source", by=["lang"], key="doc_id")
    return out.select("lang", "doc_id", "prompt_chars", "answer_chars", "total_chars", F.md5("sequence").alias("sequence"))


_LONGEST_CTE = """
d AS (SELECT lang, doc_id, 'Извлеки факты: ' || text AS prompt, source FROM documents),
r AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY length(prompt) + length(source) DESC, doc_id) AS n FROM d
)
"""
_LONGEST_EXAMPLE = f"""WITH {_LONGEST_CTE}
SELECT lang, doc_id, CAST(length(prompt) AS INT) AS prompt_chars, CAST(length(source) AS INT) AS answer_chars,
  CAST(length(prompt) + length(source) + 1 AS INT) AS total_chars, md5(prompt || chr(10) || source) AS sequence
FROM r WHERE n = 1"""


def headroom(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).withColumn("prompt", F.concat(F.lit("Извлеки факты: "), F.col("text")))
    longest = L.longest_example(docs, "prompt", "source", by=["lang"], key="doc_id")
    needs = longest.select(F.col("lang").alias("model_key"), TX.count_tokens(F.col("sequence")).alias("tokens"))
    return L.context_headroom(needs, _LIMITS)


_HEADROOM = f"""WITH {_LONGEST_CTE},
t AS (SELECT lang AS model_key, CAST({_TOKENS.format("prompt || chr(10) || source")} AS BIGINT) AS tokens FROM r WHERE n = 1),
m AS (SELECT *, CAST(CASE model_key {' '.join(f"WHEN '{k}' THEN {v}" for k, v in _LIMITS.items())} ELSE {V.DEFAULT_CONTEXT} END AS BIGINT) AS max_positions FROM t)
SELECT model_key, tokens, max_positions, max_positions - tokens AS remaining, max_positions < tokens AS over FROM m"""


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = (F.col("lang") == "de") & (F.col("n_chars") < 500)
    results = _docs(spark, sf_dir).select(
        F.col("lang").alias("model_key"), F.col("source").alias("method"), "text",
        F.when(blank, F.lit(" \n")).otherwise(F.col("text")).alias("raw_output"),
        F.when(F.col("n_chars") > 1000, F.concat(F.lit("Запрос. "), F.col("text"))).alias("prompt"),
    )
    return L.token_summary(results, rendered=F.concat(F.lit("Извлеки факты: "), F.col("text")))


def token_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _summary(spark, sf_dir)
    return out.withColumns({c: F.round(c, 6) for c in ("avg_prompt_tokens", "avg_output_tokens")}).select(
        "model_key", "method", "rows", "rows_in_file", "skipped_empty_output", "avg_prompt_tokens", "avg_output_tokens",
        *[F.coalesce(c, F.lit(-1.0)).alias(c) for c in ("median_prompt_tokens", "median_output_tokens")],
    )


_SUMMARY_CTE = f"""
d AS (
  SELECT lang AS model_key, source AS method, lang = 'de' AND n_chars < 500 AS skip,
    {_TOKENS.format("CASE WHEN n_chars > 1000 THEN 'Запрос. ' || text ELSE 'Извлеки факты: ' || text END")} AS p,
    {_TOKENS.format("text")} AS o FROM documents
),
s AS (
  SELECT model_key, method, count(*) FILTER (WHERE NOT skip) AS rows, count(*) AS rows_in_file,
    count(*) FILTER (WHERE skip) AS skipped_empty_output, avg(p) FILTER (WHERE NOT skip) AS avg_prompt_tokens,
    avg(o) FILTER (WHERE NOT skip) AS avg_output_tokens, coalesce(median(p) FILTER (WHERE NOT skip), -1) AS median_prompt_tokens,
    coalesce(median(o) FILTER (WHERE NOT skip), -1) AS median_output_tokens FROM d GROUP BY ALL
)
"""
_TOKEN_SUMMARY = f"""WITH {_SUMMARY_CTE}
SELECT model_key, method, rows, rows_in_file, skipped_empty_output, round(avg_prompt_tokens, 6) AS avg_prompt_tokens,
  round(avg_output_tokens, 6) AS avg_output_tokens, CAST(median_prompt_tokens AS DOUBLE) AS median_prompt_tokens,
  CAST(median_output_tokens AS DOUBLE) AS median_output_tokens FROM s"""


def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.token_totals(_summary(spark, sf_dir))
    return out.withColumns({c: F.round(c, 4) for c in ("avg_prompt_tokens", "avg_output_tokens")})


_TOKEN_TOTALS = f"""WITH {_SUMMARY_CTE}
SELECT count(*) AS result_sets, CAST(sum(rows) AS BIGINT) AS rows,
  round(sum(avg_prompt_tokens * rows) / sum(rows), 4) AS avg_prompt_tokens,
  round(sum(avg_output_tokens * rows) / sum(rows), 4) AS avg_output_tokens FROM s WHERE rows > 0"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    suffix = (
        F.when(kind == "click", F.date_format("ts", "_yyyyMMdd_HHmm")).when(kind == "view", F.date_format("ts", "_yyyyMMdd_HHmmss"))
        .when(kind == "signup", F.date_format("ts", "_yyyyMMdd")).otherwise(F.lit(""))
    )
    # Users with few events have folders without any dated file.
    return table(spark, sf_dir, "events").select(
        F.concat(F.col("user_id").cast("string"), F.lit("/"), F.when(kind.isin("error", "purchase"), "old").otherwise(kind)).alias("folder"),
        F.concat(F.lit("results_"), F.col("event_id").cast("string"), suffix, F.lit(".csv")).alias("name"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("mtime"),
    )


def latest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.latest_results(_files(spark, sf_dir))


_LATEST_RESULTS = """WITH f AS (
  SELECT CAST(user_id AS VARCHAR) || '/' || CASE WHEN event_type IN ('error', 'purchase') THEN 'old' ELSE event_type END AS folder,
    'results_' || CAST(event_id AS VARCHAR) || CASE event_type WHEN 'click' THEN strftime(ts, '_%Y%m%d_%H%M')
      WHEN 'view' THEN strftime(ts, '_%Y%m%d_%H%M%S') WHEN 'signup' THEN strftime(ts, '_%Y%m%d') ELSE '' END || '.csv' AS name,
    CASE event_type WHEN 'click' THEN strftime(ts, '%Y%m%d%H%M00') WHEN 'view' THEN strftime(ts, '%Y%m%d%H%M%S')
      WHEN 'signup' THEN strftime(ts, '%Y%m%d') ELSE strftime(ts, '%Y%m%d%H%M%S%f') END AS age FROM events
),
r AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY age DESC, name DESC) AS n FROM f)
SELECT folder, name FROM r WHERE n = 1"""


def attach_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of the run document with the same stem, else of the last in the folder."""
    events = table(spark, sf_dir, "events")
    folder = F.col("user_id").cast("string").alias("folder")
    stem = lambda: F.format_string("%012d", F.col("event_id")).alias("stem")
    results = events.select(folder, stem(), "event_id")
    runs = events.filter(F.col("event_type") != "error").select(
        folder, stem(), F.col("event_type").alias("template")
    )
    return L.attach_run(results, runs).select("event_id", "template")


_ATTACH_RUN = """WITH l AS (
  SELECT user_id, arg_max(event_type, event_id) AS last FROM events WHERE event_type <> 'error' GROUP BY user_id
)
SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type ELSE last END AS template FROM events LEFT JOIN l USING (user_id)"""


def resolve_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    name = (
        F.when(kind == "click", "DETAILED_INSTR_ONESHOT ").when(kind == "view", "DETAILED_INSTR_ONESHOT_OUTLINES_RUS")
        .when(kind == "signup", "MINIMAL_INSTR_FIVESHOT_GUIDANCE").when(kind == "purchase", "UNBEKANNT")
    )
    folder = F.when(F.col("value") > 20, "OLLAMA_Q8_0_MINIMAL_INSTR_FIVESHOT_OUTLINES").otherwise("results")
    templates = ["DETAILED_INSTR_ONESHOT", "DETAILED_INSTR_ONESHOT_CD_RUS", "MINIMAL_INSTR_FIVESHOT"]
    return table(spark, sf_dir, "events").select(
        "event_id", L.resolve_template(name, folder, templates, "DEFAULT").alias("template")
    )


_RESOLVE_TEMPLATE = """SELECT event_id, CASE event_type WHEN 'click' THEN 'DETAILED_INSTR_ONESHOT'
  WHEN 'view' THEN 'DETAILED_INSTR_ONESHOT_CD_RUS' WHEN 'signup' THEN 'MINIMAL_INSTR_FIVESHOT'
  ELSE CASE WHEN value > 20 THEN 'MINIMAL_INSTR_FIVESHOT' ELSE 'DEFAULT' END END AS template FROM events"""


def resolve_template_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored names of orders against a table of templates, one per order, and a table of older names."""
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    templates = orders.filter(key % 5 != 0).select(F.concat(F.lit("DETAILED_INSTR_"), key).alias("template"))
    aliases = orders.filter(key % 4 == 1).select(
        F.concat(F.lit("OLD "), key).alias("alias"), F.concat(F.lit("DETAILED_INSTR_"), key).alias("template"))
    own = F.concat(F.lit("DETAILED_INSTR_"), key)
    stored = orders.select(
        "o_orderkey",
        F.when(key % 4 == 0, F.concat(own, F.lit(" "))).when(key % 4 == 1, F.concat(F.lit("OLD "), key))
        .when(key % 4 == 2, F.concat(own, F.lit("_GUIDANCE"))).alias("name"),
        F.when(key % 3 == 0, F.concat(F.lit("VLLM_"), own, F.lit("_OUTLINES"))).otherwise("results").alias("folder"),
    )
    return DIM.resolve_templates(stored, "name", "folder", templates, aliases, "DEFAULT").select("o_orderkey", "template")


_RESOLVE_TEMPLATE_DIM = """SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 AND (o_orderkey % 4 <> 3 OR o_orderkey % 3 = 0)
  THEN 'DETAILED_INSTR_' || CAST(o_orderkey AS VARCHAR) ELSE 'DEFAULT' END AS template FROM orders"""


QUERIES = {
    "expand_escapes": (expand_escapes, _EXPAND_ESCAPES),
    "answer_text": (answer_text, _ANSWER_TEXT),
    "length_profile": (length_profile, _LENGTH_PROFILE),
    "length_profile_all": (length_profile_all, _LENGTH_PROFILE_ALL),
    "budget": (budget, _BUDGET),
    "longest_example": (longest_example, _LONGEST_EXAMPLE),
    "headroom": (headroom, _HEADROOM),
    "token_summary": (token_summary, _TOKEN_SUMMARY),
    "token_totals": (token_totals, _TOKEN_TOTALS),
    "latest_results": (latest_results, _LATEST_RESULTS),
    "attach_run": (attach_run, _ATTACH_RUN),
    "resolve_template": (resolve_template, _RESOLVE_TEMPLATE),
    "resolve_template_dim": (resolve_template_dim, _RESOLVE_TEMPLATE_DIM),
}
