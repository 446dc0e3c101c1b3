"""Queries for example selection and nearest neighbours."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanmark.catalog.inputs import spread, table
from gleanmark.functions import jsonvalue as J
from gleanmark.operators import neighbours as NB
from gleanmark.operators import selection as SEL

# DuckDB's levenshtein counts bytes, so the accents of the invented prose are folded.
_ACCENTS = ("óéñèíüçêäößÉÑÈÓÍÜÇÖÊÄ", "oeneiuceaosENEOIUCOEA")


def drop_labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text equals no labelled document's text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labeled = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return SEL.drop_labeled(docs, labeled, key="doc_id").select("doc_id")


_DROP_LABELED = r"""WITH d AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents)
SELECT doc_id FROM d WHERE t NOT IN (SELECT t FROM d WHERE doc_id IN (SELECT doc_id FROM labels))"""


def one_per_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = SEL.one_per_cluster(table(spark, sf_dir, "embeddings"), "label", "vec_id")
    return first.select("label", "vec_id")


def cluster_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SEL.cluster(table(spark, sf_dir, "embeddings")).select("vec_id", "cluster")


def cluster_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What 100 clusters, the best of 10 runs, must fulfil."""
    return SEL.cluster_invariants(table(spark, sf_dir, "embeddings"), "vec_id").select(
        "n_rows", "n_misplaced", "n_without_candidate", "cost_is_least")


def _folded(col: str = "text") -> Column:
    return F.translate(col, *_ACCENTS)


def _three_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions of every turn, as if sampled: as is, lower case without e, without th."""
    text = _folded()
    versions = F.array(text, F.replace(F.lower(text), F.lit("e"), F.lit("")), F.replace(text, F.lit("th"), F.lit("")))
    turns = spread(table(spark, sf_dir, "conversations"), rows=5000)
    return turns.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("text_index"), versions.alias("responses")
    )


_RESPONSES_CTE = f"""
r0 AS (SELECT conv_id * 100 + turn AS text_index, translate(text, '{_ACCENTS[0]}', '{_ACCENTS[1]}') AS a FROM conversations),
r AS (SELECT text_index, a, replace(lower(a), 'e', '') AS b, replace(a, 'th', '') AS c FROM r0),
g AS (
  SELECT text_index, (levenshtein(a, b) / greatest(length(a), length(b), 1)
    + levenshtein(a, c) / greatest(length(a), length(c), 1)
    + levenshtein(b, c) / greatest(length(b), length(c), 1)) / 3 AS gd FROM r
)
"""


def pair_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _three_responses(spark, sf_dir).select(
        "text_index", F.round(SEL.generation_disagreement(F.col("responses")), 6).alias("disagreement")
    )


_PAIR_DISAGREEMENT = f"WITH {_RESPONSES_CTE} SELECT text_index, round(gd, 6) AS disagreement FROM g"


def rank_uncertain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 most uncertain turns (a top-n report); prose never reads as a record."""
    scored = SEL.score_uncertainty(_three_responses(spark, sf_dir))
    return SEL.rank_uncertain(scored, 25).select(
        "text_index", F.round("total_uncertainty", 6).alias("total_uncertainty"), "r_fail", "content_uncertainty"
    )


_RANK_UNCERTAIN = f"""WITH {_RESPONSES_CTE}
SELECT text_index, round(0.33 * gd + 0.33, 6) AS total_uncertainty, CAST(1.0 AS DOUBLE) AS r_fail,
       CAST(0.0 AS DOUBLE) AS content_uncertainty
FROM g ORDER BY 0.33 * gd + 0.33 DESC, text_index LIMIT 25"""


def _event_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three answers per event: a record, one with another value or key, and sometimes prose."""
    value = F.floor("value").cast("string")
    other = (F.floor("value") + 1).cast("string")
    kind = F.col("event_type")

    def record(v: Column, extra: str = "") -> Column:
        return F.concat(
            F.lit('{"массовая доля": [{"вещество": "N", "массовая доля": '), v,
            F.lit(f'}}, {{"вещество": "K", "массовая доля": 1}}]{extra}}}'),
        )

    second = F.when(kind == "click", record(value)).when(
        kind == "view", record(other, ', "прочее": [{"параметр": "p", "значение": "x"}]')
    ).otherwise(record(other))
    third = F.when(kind == "error", F.lit("нет ответа")).when(kind == "signup", F.lit("[1]")).otherwise(record(value))
    return spread(table(spark, sf_dir, "events")).select(
        F.col("event_id").alias("text_index"), F.array(record(value), second, third).alias("responses")
    )


def format_and_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = SEL.score_uncertainty(_event_responses(spark, sf_dir))
    return scored.select(
        "text_index",
        *[F.round(c, 6).alias(c) for c in ("r_fail", "structural_disagreement", "format_uncertainty", "content_uncertainty")],
        F.length("json").alias("json_chars"),
    )


# Fact sets: {N:v, K:1}, {N:v+1, K:1} (for view also p:x).  Prose counts as an
# empty object, a list as none.
_FORMAT_AND_CONTENT = """WITH e AS (
  SELECT event_id AS text_index, event_type AS t, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS v FROM events
),
s AS (
  SELECT text_index, v, CASE WHEN t IN ('error', 'signup') THEN 1.0 / 3 ELSE 0.0 END AS r_fail,
    CASE WHEN t = 'view' THEN (0.5 + 0.0 + 0.5) / 3 ELSE 0.0 END AS structural_disagreement,
    CASE t WHEN 'click' THEN 0.0 WHEN 'view' THEN 1 - (0.25 + 1 + 0.25) / 3
      WHEN 'error' THEN 1 - (1.0 / 3 + 0 + 0) / 3 WHEN 'signup' THEN 1 - 1.0 / 3
      ELSE 1 - (1.0 / 3 + 1 + 1.0 / 3) / 3 END AS content_uncertainty
  FROM e
)
SELECT text_index, round(r_fail, 6) AS r_fail, round(structural_disagreement, 6) AS structural_disagreement,
  round((r_fail + structural_disagreement) / 2, 6) AS format_uncertainty,
  round(content_uncertainty, 6) AS content_uncertainty,
  CAST(length('{"массовая доля": [{"вещество": "N", "массовая доля": }, {"вещество": "K", "массовая доля": 1}]}') + length(v) AS INT) AS json_chars
FROM s"""


def best_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first answer that reads as an object; lists and blanks are passed over."""
    kind = F.col("event_type")
    first = F.when(kind == "click", F.lit(" ")).when(kind == "view", F.lit("[1]")).otherwise(F.lit("Ответ: нет"))
    rows = spread(table(spark, sf_dir, "events")).select(
        F.col("event_id").alias("text_index"), F.array(first, F.concat(F.lit("x "), F.col("props"))).alias("responses")
    )
    return SEL.score_uncertainty(rows).select("text_index", "json")


_BEST_JSON = """SELECT event_id AS text_index, CASE WHEN event_type IN ('click', 'view') THEN props ELSE 'нет' END AS json
FROM events"""


def jaccard_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of the word sets of whole turns with and without lower-casing."""
    words = lambda c: F.array_distinct(F.split(c, " "))
    return spread(table(spark, sf_dir, "conversations")).select(
        "conv_id", "turn",
        F.round(SEL.jaccard(words(F.col("text")), words(F.lower("text"))), 6).alias("similarity"),
    )


_JACCARD_CONTENT = """WITH w AS (
  SELECT conv_id, turn, list_distinct(string_split(text, ' ')) AS a, list_distinct(string_split(lower(text), ' ')) AS b
  FROM conversations
)
SELECT conv_id, turn, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM w"""


def fact_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of a record; a falsy value gives way to the next key."""
    number = F.col("value").cast("string")
    record = F.concat(
        F.lit('{"массовая доля": [{"вещество": "N", "массовая доля": '), number,
        F.lit('}, {"вещество": "", "массовая доля": 1}, {"вещество": "P"}], "прочее": [{"параметр": "m", "значение": "", "масса": 0, "количество": '),
        number, F.lit(', "объем": null}, {"параметр": "r", "масса": [1, null]}, {"параметр": "z"}]}'),
    )
    rows = spread(table(spark, sf_dir, "events")).select("event_id", J.parse_whole(record).alias("record"))
    facts = F.transform(SEL.fact_set(F.col("record")), lambda f: F.replace(f, F.lit("\u0001"), F.lit("/")))
    return rows.select("event_id", F.array_join(F.array_sort(facts), ";").alias("facts"))


_FACT_SETS = """SELECT event_id, 'mass/N:' || CAST(value AS VARCHAR) || ';mass/P:;other/m:' ||
  CASE WHEN value = 0 THEN 'None' ELSE CAST(value AS VARCHAR) END || ';other/r:[1, None];other/z:None' AS facts FROM events"""


def knn_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = NB.knn_outliers(table(spark, sf_dir, "embeddings"), "vec_id")
    return rows.select("vec_id", F.round("outlier_score", 4).alias("outlier_score"), "is_outlier")


_KNN_OUTLIERS = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (
  SELECT a.vec_id, 1 - list_cosine_similarity(a.v, b.v) AS d,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY 1 - list_cosine_similarity(a.v, b.v)) AS rk
  FROM e a, e b WHERE a.vec_id <> b.vec_id
),
s AS (SELECT vec_id, avg(d) AS m FROM p WHERE rk <= 20 GROUP BY vec_id)
SELECT vec_id, round(m, 4) AS outlier_score, m > (SELECT quantile_cont(m, 0.95) FROM s) AS is_outlier FROM s"""


def fewshot_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt block from the first five labelled documents of each language."""
    pool = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(
        F.col("lang").alias("model_key"), F.col("doc_id").alias("pos"), "text",
        F.concat(F.lit(' {"q": '), F.col("quality").cast("string"), F.lit("} ")).alias("json"),
    )
    return SEL.fewshot_block(pool).select("model_key", F.md5("block").alias("block"))


_FEWSHOT_BLOCK = r"""WITH p AS (
  SELECT lang, doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, quality,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n
  FROM documents JOIN labels USING (doc_id)
)
SELECT lang AS model_key, md5(string_agg('Текст примера ' || CAST(n AS VARCHAR) || ': ' || text || chr(10) || chr(10) ||
  'Ответ примера ' || CAST(n AS VARCHAR) || ': {"q": ' || CAST(quality AS VARCHAR) || '}', chr(10) || chr(10) ORDER BY n)) AS block
FROM p WHERE n <= 5 GROUP BY lang"""


def latest_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.when(F.col("value") > 20, ".xlsx").otherwise(".csv")
    files = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("model_key"),
        F.concat(F.lit("pool/few_shot_examples_"), F.col("event_id").cast("string"), ext).alias("path"),
        F.col("ts").alias("mtime"),
    )
    return SEL.latest_pool(files)


_LATEST_POOL = """WITH f AS (
  SELECT CAST(user_id AS VARCHAR) AS model_key, value > 20 AS x, ts, event_id,
         'pool/few_shot_examples_' || CAST(event_id AS VARCHAR) || CASE WHEN value > 20 THEN '.xlsx' ELSE '.csv' END AS path
  FROM events
),
r AS (SELECT *, row_number() OVER (PARTITION BY model_key ORDER BY x DESC, ts DESC, path DESC) AS n FROM f)
SELECT model_key, path FROM r WHERE n = 1"""


QUERIES = {
    "drop_labeled": (drop_labeled, _DROP_LABELED),
    "one_per_cluster": (one_per_cluster, "SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label"),
    "cluster_kmeans": (cluster_kmeans, None),
    "cluster_invariants": (cluster_invariants, """SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_misplaced,
  CAST(0 AS BIGINT) AS n_without_candidate, true AS cost_is_least FROM embeddings"""),
    "pair_disagreement": (pair_disagreement, _PAIR_DISAGREEMENT),
    "rank_uncertain": (rank_uncertain, _RANK_UNCERTAIN),
    "format_and_content": (format_and_content, _FORMAT_AND_CONTENT),
    "best_json": (best_json, _BEST_JSON),
    "jaccard_content": (jaccard_content, _JACCARD_CONTENT),
    "fact_sets": (fact_sets, _FACT_SETS),
    "knn_outliers": (knn_outliers, _KNN_OUTLIERS),
    "fewshot_block": (fewshot_block, _FEWSHOT_BLOCK),
    "latest_pool": (latest_pool, _LATEST_POOL),
}
