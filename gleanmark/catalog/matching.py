"""Queries for matching, quality, error tables and whole evaluations."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanmark.catalog.inputs import LINE_ENTRIES_SQL, line_entries, order_texts, percent, spread, table
from gleanmark.functions import jsonvalue as J
from gleanmark.functions import text as TX
from gleanmark.operators import errors as ER
from gleanmark.operators import matching as M
from gleanmark.operators.entries import PREDICTED, TRUTH, explode_entries
from gleanmark.operators.salvage import process_responses
from gleanmark.plans import evaluation as EV
from gleanmark.session import materialize


def match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.score_texts(line_entries(spark, sf_dir)).select(
        "run_id", "text_index", "grp", "tp", "fp", "fn", F.round("score", 6).alias("score")
    )


_MATCH_COUNTS = f"""WITH {LINE_ENTRIES_SQL}
SELECT run_id, text_index, grp, tp, fp, fn, round(tp / (tp + fp + fn), 6) AS score FROM per_text"""


def quality_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.quality(M.score_texts(line_entries(spark, sf_dir)))
    return out.select(
        "run_id", "grp", "tp", "fp", "fn", "comparisons",
        *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")],
    )


_QUALITY_MICRO = f"""WITH {LINE_ENTRIES_SQL},
s AS (
  SELECT run_id, grp, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp,
         CAST(sum(fn) AS BIGINT) AS fn FROM per_text GROUP BY ALL
)
SELECT run_id, grp, tp, fp, fn, tp + fp + fn AS comparisons, round(tp / (tp + fp), 6) AS precision,
       round(tp / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM s"""


def accuracy_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.quality(M.score_texts(line_entries(spark, sf_dir))).select(
        "run_id", "grp", F.round("accuracy", 6).alias("accuracy")
    )


_ACCURACY_MACRO = f"""WITH {LINE_ENTRIES_SQL}
SELECT run_id, grp, round(avg(tp / (tp + fp + fn)), 6) AS accuracy FROM per_text GROUP BY ALL"""


def entry_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.entry_errors(line_entries(spark, sf_dir)).select(
        "run_id", "text_index", "grp", "side", "pos", "message"
    )


_ERRORS_CTE = """
ranked AS (
  SELECT e.*, row_number() OVER (PARTITION BY run_id, text_index, grp, key, value, side ORDER BY pos) AS rk
  FROM entries e
),
surplus AS (
  SELECT r.* FROM ranked r JOIN counted c USING (run_id, text_index, grp, key, value)
  WHERE r.rk > least(c.np, c.nt)
),
first_true AS (
  SELECT run_id, text_index, grp, key, count(*) FILTER (WHERE side = 0) AS n_wrong,
         arg_min(value, pos) FILTER (WHERE side = 1) AS tv, count(*) FILTER (WHERE side = 1) AS n_open
  FROM surplus GROUP BY ALL
),
errs AS (
  SELECT s.run_id, s.text_index, s.grp, s.side, s.pos,
    CASE WHEN s.grp = 'mass' THEN 'Вещество ' ELSE 'Параметр ' END || s.key || ': предсказано ' ||
    CASE WHEN s.side = 0
      THEN CAST(s.value AS VARCHAR) || CASE WHEN s.grp = 'mass' THEN '' ELSE ', единица: кг' END
      ELSE 'отсутствует' END || ', истина ' ||
    CASE WHEN s.side = 1
      THEN CAST(s.value AS VARCHAR) || CASE WHEN s.grp = 'mass' THEN '' ELSE ', единица: кг' END
      WHEN f.n_open = 0 THEN 'отсутствует'
      ELSE CAST(f.tv AS VARCHAR) || CASE WHEN s.grp = 'mass' THEN '' ELSE ', единица: кг' END END AS message
  FROM surplus s JOIN first_true f USING (run_id, text_index, grp, key)
  WHERE s.side = 0 OR f.n_wrong = 0
)
"""
_ENTRY_ERRORS = f"""WITH {LINE_ENTRIES_SQL}, {_ERRORS_CTE}
SELECT run_id, text_index, grp, side, pos, message FROM errs"""


def errors_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ER.errors_by_text(M.entry_errors(line_entries(spark, sf_dir))).select(
        "run_id", "text_index", "part", F.array_join("errors", " | ").alias("errors")
    )


_ERRORS_BY_TEXT = f"""WITH {LINE_ENTRIES_SQL}, {_ERRORS_CTE}
SELECT run_id, text_index, CAST(0 AS BIGINT) AS part,
       string_agg(message, ' | ' ORDER BY CASE WHEN grp = 'mass' THEN 0 ELSE 1 END, side, pos) AS errors
FROM errs GROUP BY run_id, text_index"""


def strict_vs_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values written as text, percent, range, empty range, decimal or integer."""
    d, q = percent("l_discount"), F.col("l_quantity").cast("int").cast("string")
    written = (
        F.when(d <= 2, F.concat(F.lit('"'), q, F.lit('%"')))
        .when(d <= 4, F.concat(F.lit("["), q, F.lit(", "), q, F.lit("]")))
        .when(d == 5, F.lit("[null, null]"))
        .when(d == 6, F.concat(q, F.lit(".0")))
        .when(d == 7, F.concat(F.lit('" '), q, F.lit(' "')))
        .otherwise(q)
    )

    def record(value):
        return F.concat(
            F.lit('{"массовая доля": [{"вещество": "'), F.col("l_returnflag"),
            F.lit('", "массовая доля": '), value, F.lit("}]}"),
        )

    rows = spread(table(spark, sf_dir, "lineitem")).select(
        F.lit("r").alias("run_id"), F.col("l_orderkey").alias("text_index"),
        J.parse_whole(record(written)).alias("prediction"), J.parse_whole(record(q)).alias("truth"),
    )
    sides = {PREDICTED: "prediction", TRUTH: "truth"}
    out = None
    for mode, strict in (("lenient", False), ("strict", True)):
        entries = explode_entries(rows, sides, ["run_id", "text_index"], strict)
        one = M.score_texts(entries).groupBy("grp").agg(
            *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
        ).select(F.lit(mode).alias("mode"), "grp", "tp", "fp", "fn")
        out = one if out is None else out.unionByName(one)
    return out


_STRICT_VS_LENIENT = """WITH lines AS (
  SELECT l_orderkey AS t, l_returnflag AS key, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS q,
         CAST(round(l_discount * 100) AS INT) AS d FROM lineitem
),
e AS (
  SELECT 'lenient' AS mode, t, key, q AS v, 0 AS side FROM lines WHERE d <> 5
  UNION ALL SELECT 'strict', t, key, CASE WHEN d IN (3, 4) THEN '[' || q || ']' WHEN d = 5 THEN 'nulls' ELSE q END, 0
  FROM lines
  UNION ALL SELECT 'lenient', t, key, q, 1 FROM lines
  UNION ALL SELECT 'strict', t, key, q, 1 FROM lines
),
c AS (
  SELECT mode, t, key, v, count(*) FILTER (WHERE side = 0) AS np, count(*) FILTER (WHERE side = 1) AS nt
  FROM e GROUP BY ALL
),
k AS (
  SELECT mode, t, key, sum(least(np, nt)) AS tp, sum(np - least(np, nt)) AS fp, sum(nt - least(np, nt)) AS o
  FROM c GROUP BY ALL
)
SELECT mode, 'mass' AS grp, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp,
       CAST(sum(CASE WHEN fp = 0 THEN o ELSE 0 END) AS BIGINT) AS fn
FROM k GROUP BY mode"""


def substance_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.translate("p_name", "aeocpxykmht", "аеосрхукмнт")
    return table(spark, sf_dir, "part").select(
        "p_partkey", (name != F.col("p_name")).alias("has_cyrillic"),
        TX.norm_substance(name).alias("normalized"),
    )


_SUBSTANCE_NORM = """SELECT p_partkey, translate(p_name, 'aeocpxykmht', 'аеосрхукмнт') <> p_name AS has_cyrillic,
upper(p_name) AS normalized FROM part"""


def evaluate_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spread(order_texts(spark, sf_dir), by="text_index")
    corpus = texts.select("text_index", "text", "truth_json")
    responses = texts.drop("truth_json")
    out = EV.Evaluation(responses, corpus).quality()
    return out.select(
        "run_id", "grp", "tp", "fp", "fn",
        *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")],
    )


# Mass has two true entries, other two.  Level 2 has one of the two mass
# values wrong, level 4 misses all, the rest match.
_EVALUATE_QUALITY = """WITH o AS (SELECT o_orderstatus AS run_id, left(o_orderpriority, 1) AS l FROM orders),
t AS (
  SELECT run_id, grp,
    CASE WHEN l = '4' THEN 0 WHEN l = '2' AND grp = 'mass' THEN 1 ELSE 2 END AS tp,
    CASE WHEN l = '2' AND grp = 'mass' THEN 1 ELSE 0 END AS fp,
    CASE WHEN l = '4' THEN 2 ELSE 0 END AS fn
  FROM o, (VALUES ('mass'), ('other')) g(grp)
),
s AS (
  SELECT run_id, grp, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp,
         CAST(sum(fn) AS BIGINT) AS fn, avg(tp / (tp + fp + fn)) AS acc FROM t GROUP BY ALL
)
SELECT run_id, grp, tp, fp, fn, round(acc, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision,
       round(tp / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM s"""


def raw_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spread(order_texts(spark, sf_dir), by="text_index")
    raw = EV.RawQuality(texts.drop("truth_json"), texts.select("text_index", "truth_json"))
    scores = raw.quality().select(
        "run_id", "grp", "tp", "fp", "fn", F.round("accuracy", 6).alias("accuracy"), F.round("f1", 6).alias("f1")
    )
    return scores.join(
        raw.validation().select("run_id", "valid_count", "invalid_count"), "run_id"
    )


# Strictly, only whole JSON (levels 1 and 5) gives the record; the object
# pattern reads one nested level, so it finds the whole record in level 2,
# but only a first entry in the truncated level 3.
_RAW_QUALITY = """WITH o AS (SELECT o_orderstatus AS run_id, left(o_orderpriority, 1) AS l FROM orders),
t AS (
  SELECT run_id, l, grp,
    CASE WHEN l IN ('3', '4') THEN 0 WHEN l = '2' AND grp = 'mass' THEN 1
         WHEN l = '5' AND grp = 'other' THEN 0 ELSE 2 END AS tp,
    CASE WHEN l = '2' AND grp = 'mass' THEN 1 ELSE 0 END AS fp,
    CASE WHEN l IN ('3', '4') OR (l = '5' AND grp = 'other') THEN 2 ELSE 0 END AS fn
  FROM o, (VALUES ('mass'), ('other')) g(grp)
),
s AS (
  SELECT run_id, grp, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
         avg(tp / (tp + fp + fn)) AS acc, count(*) FILTER (WHERE l IN ('1', '2', '5')) AS valid_count,
         count(*) FILTER (WHERE l IN ('3', '4')) AS invalid_count
  FROM t GROUP BY ALL
)
SELECT run_id, grp, tp, fp, fn, round(acc, 6) AS accuracy, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1,
       valid_count, invalid_count FROM s"""


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    texts = spread(order_texts(spark, sf_dir), by="text_index")
    stored = process_responses(texts.drop("truth_json")).withColumn("json_parsed", F.to_json("record"))
    return stored.drop("record"), texts.select("text_index", "text", "truth_json")


def rescore_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = EV.Rescoring(*_stored(spark, sf_dir))
    return again.counts().withColumn("parsing_error_rate", F.round("parsing_error_rate", 6)).join(
        again.validation().select("run_id", "raw_valid", "parsed_valid", "not_parsed"), "run_id"
    )


_RESCORE_COUNTS = """SELECT o_orderstatus AS run_id, count(*) AS total_samples,
  count(*) FILTER (WHERE left(o_orderpriority, 1) <> '4') AS reparsed,
  count(*) FILTER (WHERE left(o_orderpriority, 1) <> '4') AS valid_json_count,
  count(*) FILTER (WHERE left(o_orderpriority, 1) = '4') AS invalid_json_count,
  round(count(*) FILTER (WHERE left(o_orderpriority, 1) = '4') / count(*), 6) AS parsing_error_rate,
  count(*) FILTER (WHERE left(o_orderpriority, 1) IN ('1', '2', '5')) AS raw_valid,
  count(*) FILTER (WHERE left(o_orderpriority, 1) <> '4') AS parsed_valid,
  count(*) FILTER (WHERE left(o_orderpriority, 1) = '4') AS not_parsed
FROM orders GROUP BY 1"""


def _unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spread(order_texts(spark, sf_dir), by="text_index")
    prompt = F.concat(F.lit("Извлеки: "), F.col("text")).alias("prompt")
    processed = materialize(process_responses(texts.drop("truth_json")), "responses")
    corpus = texts.select("text_index", "truth_json")
    entries = EV.entries_of(EV.paired(EV.object_or_empty(processed, "record"), corpus, "record"))
    about = processed.select("run_id", "text_index", "text", F.col("json").alias("response"), prompt)
    quality = M.entry_errors(entries).join(about, ["run_id", "text_index"])
    parse = ER.parse_errors(processed).withColumn("prompt", F.lit(None).cast("string"))
    checks = processed.filter(~F.col("raw_valid") | ~F.col("parsed_valid")).select(
        "run_id", "text_index", F.col("raw_output").alias("response"), prompt,
        F.col("raw_output").alias("initial_response"),
        F.when(~F.col("raw_valid"), "raw").otherwise("parsed").alias("validation_errors"),
    )
    return ER.unified_errors(parse, quality, checks)


def unified_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unified(spark, sf_dir).select(
        "run_id", "text_index", "part", "text", "response", "prompt", "initial_response", "validation_errors",
        F.array_join("errors", " | ").alias("errors"),
    )


_UNIFIED_CTE = """
o AS (
  SELECT o_orderstatus AS run_id, o_orderkey AS text_index, left(o_orderpriority, 1) AS l,
         CAST(o_custkey AS VARCHAR) AS c, CAST(floor(o_totalprice) AS BIGINT) AS a, o_orderstatus AS s,
         'заказ ' || CAST(o_orderkey AS VARCHAR) AS text
  FROM orders
),
u AS (
  SELECT run_id, text_index, CAST(0 AS BIGINT) AS part, text,
    CASE WHEN l = '2' THEN '{"массовая доля":[{"вещество":"N","массовая доля":' || CAST(a + 1 AS VARCHAR)
      || '},{"вещество":"К2О","массовая доля":"' || c || '%"}],"прочее":[{"единица":"кг","масса":' || c
      || ',"параметр":"масса"},{"значение":"' || s || '","параметр":"статус"}]}'
      ELSE 'данных нет ' || c END AS response,
    'Извлеки: ' || text AS prompt,
    CASE WHEN l = '2'
      THEN ['Вещество N: предсказано ' || CAST(a + 1 AS VARCHAR) || ', истина ' || CAST(a AS VARCHAR)]
      ELSE ['Невалидный JSON. Ответ: данных нет ' || c,
            'Вещество N: предсказано отсутствует, истина ' || CAST(a AS VARCHAR),
            'Вещество К2О: предсказано отсутствует, истина ' || c || '%',
            'Параметр масса: предсказано отсутствует, истина ' || c || '.0, единица: кг',
            'Параметр статус: предсказано отсутствует, истина ' || lower(s)] END AS errs
  FROM o WHERE l IN ('2', '4')
)
"""
_UNIFIED_ERRORS = f"""WITH {_UNIFIED_CTE}
SELECT run_id, text_index, part, text, response, prompt, CASE WHEN len(errs) > 1 THEN response END AS initial_response,
  CASE WHEN len(errs) > 1 THEN 'raw' END AS validation_errors, array_to_string(errs, ' | ') AS errors FROM u"""


def error_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = ER.error_digest(_unified(spark, sf_dir))
    return digest.select(
        "run_id",
        F.array_join(F.transform("texts", lambda t: t["text"]), " | ").alias("texts"),
        F.array_join("lines", " | ").alias("lines"),
    )


_ERROR_DIGEST = f"""WITH {_UNIFIED_CTE},
r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY text_index) AS rn FROM u),
lines AS (
  SELECT run_id, 'Текст #' || CAST(text_index AS VARCHAR) || ': ' || e AS line,
         row_number() OVER (PARTITION BY run_id ORDER BY text_index, i) AS ln
  FROM (SELECT run_id, text_index, unnest(errs) AS e, generate_subscripts(errs, 1) AS i FROM r WHERE rn <= 10)
)
SELECT run_id, (SELECT string_agg(text, ' | ' ORDER BY rn) FROM r WHERE r.run_id = x.run_id AND rn <= 3) AS texts,
       (SELECT string_agg(line, ' | ' ORDER BY ln) FROM lines WHERE lines.run_id = x.run_id AND ln <= 10) AS lines
FROM (SELECT DISTINCT run_id FROM u) x"""


def error_digest_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of runs whose first text has about half of all errors, far more than one part holds."""
    few = F.col("l_quantity") < 25
    errors = table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("run_id"),
        F.when(few, F.lit(1)).otherwise(F.col("l_orderkey") + 10).cast("bigint").alias("text_index"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
        F.concat(F.lit("e"), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string")).alias("message"),
    )
    rows = ER.errors_by_text(errors).withColumns(
        {"text": F.concat(F.lit("t"), F.col("text_index").cast("string")), "response": F.lit("")}
    )
    return ER.error_digest(rows).select(
        "run_id",
        F.array_join(F.transform("texts", lambda t: t["text"]), " | ").alias("texts"),
        F.md5(F.array_join(F.flatten(F.transform("texts", lambda t: t["errors"])), " | ")).alias("errors"),
        F.array_join("lines", " | ").alias("lines"),
    )


_ERROR_DIGEST_LARGE = """WITH e AS (
  SELECT l_linestatus AS run_id, CASE WHEN l_quantity < 25 THEN 1 ELSE l_orderkey + 10 END AS text_index,
         l_orderkey * 10 + l_linenumber AS ord,
         'e' || CAST(l_orderkey AS VARCHAR) || '.' || CAST(l_linenumber AS VARCHAR) AS message
  FROM lineitem
),
r AS (
  SELECT *, dense_rank() OVER (PARTITION BY run_id ORDER BY text_index) AS rn,
         row_number() OVER (PARTITION BY run_id ORDER BY text_index, ord) AS ln FROM e
)
SELECT run_id, (SELECT string_agg('t' || CAST(text_index AS VARCHAR), ' | ' ORDER BY text_index)
                FROM (SELECT DISTINCT run_id, text_index FROM r WHERE rn <= 3) t WHERE t.run_id = x.run_id) AS texts,
       md5(string_agg(message, ' | ' ORDER BY text_index, ord) FILTER (WHERE rn <= 3)) AS errors,
       string_agg('Текст #' || CAST(text_index AS VARCHAR) || ': ' || message, ' | ' ORDER BY ln) FILTER (WHERE ln <= 10) AS lines
FROM r x GROUP BY run_id"""


def rescore_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EV.Rescoring(*_stored(spark, sf_dir)).quality().select(
        "run_id", "grp", "tp", "fp", "fn",
        *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")],
    )


def _joined_errors(errors: DataFrame) -> DataFrame:
    return errors.select("run_id", "text_index", "part", F.array_join("errors", " | ").alias("errors"))


def rescore_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined_errors(EV.Rescoring(*_stored(spark, sf_dir)).errors())


_RESCORE_ERRORS = f"""WITH {_UNIFIED_CTE}
SELECT run_id, text_index, part, array_to_string(CASE WHEN len(errs) > 1 THEN errs[2:] ELSE errs END, ' | ') AS errors FROM u"""


def raw_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the responses as they stand, strictly read."""
    texts = spread(order_texts(spark, sf_dir), by="text_index")
    return _joined_errors(EV.RawQuality(texts.drop("truth_json"), texts.select("text_index", "truth_json")).errors())


_RAW_ERRORS = """WITH o AS (
  SELECT o_orderstatus AS run_id, o_orderkey AS text_index, left(o_orderpriority, 1) AS l, CAST(o_custkey AS VARCHAR) AS c,
         CAST(floor(o_totalprice) AS BIGINT) AS a, o_orderstatus AS s FROM orders
),
m AS (
  SELECT *, ['Вещество N: предсказано отсутствует, истина ' || CAST(a AS VARCHAR),
             'Вещество К2О: предсказано отсутствует, истина ' || c || '%'] AS mass,
         ['Параметр масса: предсказано отсутствует, истина ' || c || '.0, единица: кг',
          'Параметр статус: предсказано отсутствует, истина ' || lower(s)] AS other
  FROM o
)
SELECT run_id, text_index, CAST(0 AS BIGINT) AS part, array_to_string(
  CASE WHEN l = '2' THEN ['Вещество N: предсказано ' || CAST(a + 1 AS VARCHAR) || ', истина ' || CAST(a AS VARCHAR)]
       WHEN l = '5' THEN other ELSE list_concat(mass, other) END, ' | ') AS errors
FROM m WHERE l <> '1'"""


QUERIES = {
    "error_digest_large": (error_digest_large, _ERROR_DIGEST_LARGE),
    "rescore_quality": (rescore_quality, _EVALUATE_QUALITY),
    "rescore_errors": (rescore_errors, _RESCORE_ERRORS),
    "raw_errors": (raw_errors, _RAW_ERRORS),
    "match_counts": (match_counts, _MATCH_COUNTS),
    "quality_micro": (quality_micro, _QUALITY_MICRO),
    "accuracy_macro": (accuracy_macro, _ACCURACY_MACRO),
    "entry_errors": (entry_errors, _ENTRY_ERRORS),
    "errors_by_text": (errors_by_text, _ERRORS_BY_TEXT),
    "strict_vs_lenient": (strict_vs_lenient, _STRICT_VS_LENIENT),
    "substance_norm": (substance_norm, _SUBSTANCE_NORM),
    "evaluate_quality": (evaluate_quality, _EVALUATE_QUALITY),
    "raw_quality": (raw_quality, _RAW_QUALITY),
    "rescore_counts": (rescore_counts, _RESCORE_COUNTS),
    "unified_errors": (unified_errors, _UNIFIED_ERRORS),
    "error_digest": (error_digest, _ERROR_DIGEST),
}
