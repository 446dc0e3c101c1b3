"""Queries that read the events as a stream and return what it wrote."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanmark.catalog.inputs import table
from gleanmark.operators.salvage import process_responses
from gleanmark.plans.ranks import running_total
from gleanmark.session import materialize, scratch_path
from gleanmark.sources import tables as T
from gleanmark.streaming import guard as G
from gleanmark.streaming import monitor as MON
from gleanmark.streaming import registry as REG
from gleanmark.streaming import windows as W

ARRIVALS = 3
# Seconds; about the mean of all events, so that some runs exceed it for a while only.
GUARD_LIMIT = 55.0


def _arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _arriving(spark, sf_dir).select(
        F.col("event_type").alias("run_id"), (F.col("value") > 5).alias("is_valid"), F.col("value").alias("elapsed_s")
    )
    # The texts of a run: its events and as many again as there are distinct users in it.
    totals = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("run_id")).agg(
        (F.count("*") + F.count_distinct("user_id")).alias("total")
    )
    state = MON.progress(log, totals)
    path = scratch_path(spark, "progress")
    MON.write_updates(state, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return MON.latest_updates(spark, f"{path}/rows", state.schema)


def progress_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _progress(spark, sf_dir).select(
        "run_id", "processed", "valid", "invalid", "remaining", F.round("mean_s", 6).alias("mean_s"), F.round("eta_s", 3).alias("eta_s")
    )


_PROGRESS = """SELECT event_type AS run_id, count(*) AS processed, count(*) FILTER (WHERE value > 5) AS valid,
  count(*) FILTER (WHERE NOT value > 5) AS invalid, count(DISTINCT user_id) AS remaining, round(avg(value), 6) AS mean_s,
  round(avg(value) * count(DISTINCT user_id), 3) AS eta_s FROM events GROUP BY 1"""


def over_budget_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MON.over_budget(_progress(spark, sf_dir), limit_s=20.0).select("run_id")


def processed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses salvaged and validated as they arrive."""
    log = _arriving(spark, sf_dir).select(
        F.lit("r").alias("run_id"), F.col("event_id").alias("text_index"), F.lit("t").alias("text"),
        F.concat(F.lit("Ответ: "), F.when(F.col("event_type") == "error", F.lit("нет")).otherwise(F.col("props"))).alias("raw_output"),
    )
    path = scratch_path(spark, "processed")
    MON.append_processed(process_responses(log), f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/rows").select("text_index", "json", "is_valid", "raw_valid")


_PROCESSED = """SELECT event_id AS text_index, CASE WHEN event_type = 'error' THEN 'нет'
  ELSE '{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' END AS json,
  event_type <> 'error' AS is_valid, event_type <> 'error' AS raw_valid FROM events"""


def _arrive(log: DataFrame, path: str, start: Callable[[DataFrame, str], StreamingQuery], arrival: str = "arrival") -> None:
    """Let the rows of ``log`` arrive one ``arrival`` after the other in ``path``/log; the stream runs after each.

    ``start`` starts the query on the stream with a checkpoint, from which the next run goes on.
    """
    spark, schema = log.sparkSession, log.drop(arrival).schema
    for number in range(ARRIVALS):
        log.filter(F.col(arrival) == number).drop(arrival).write.mode("append").parquet(f"{path}/log")
        start(spark.readStream.schema(schema).parquet(f"{path}/log"), f"{path}/checkpoint").awaitTermination()


def guard_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs given up by the time guard; a run per user, its texts in order of the events, arriving out of order."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run_id"), "event_id", "value")
    log = running_total(events, ["run_id"], "event_id", "n").select(
        "run_id", (F.col("n") - 1).alias("position"), F.col("value").alias("elapsed_s"),
        (F.col("event_id") * 7 % ARRIVALS).alias("arrival"),
    )
    log, path = materialize(log, "guard-log"), scratch_path(spark, "guard")
    schema = G.guard_states(log, GUARD_LIMIT).schema

    def start(stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return MON.write_updates(G.guard_states(stream, GUARD_LIMIT), f"{path}/rows", checkpoint)

    _arrive(log, path, start)
    totals = log.groupBy("run_id").agg(F.count("*").alias("total"))
    return G.guard_trips(MON.latest_updates(spark, f"{path}/rows", schema), totals).select(
        "run_id", "last_index", F.round("mean_s", 6).alias("mean_s"), "responses_after")


_GUARD_TRIPS = """WITH e AS (
  SELECT CAST(user_id AS VARCHAR) AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS position,
         CAST(round(value * 1000000) AS BIGINT) AS us FROM events
), r AS (
  SELECT run_id, position, sum(us) OVER (PARTITION BY run_id ORDER BY position) AS total,
         count(*) OVER (PARTITION BY run_id) AS texts FROM e
), t AS (
  SELECT run_id, texts, min(position) AS p FROM r WHERE total > 55000000 * (position + 1) GROUP BY run_id, texts
)
SELECT t.run_id, p AS last_index, round(total / (p + 1) / 1000000, 6) AS mean_s, t.texts - p - 1 AS responses_after
FROM t JOIN r ON r.run_id = t.run_id AND r.position = p WHERE p + 1 < t.texts"""


def _timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in three arrivals by id, some of them one arrival late."""
    events = table(spark, sf_dir, "events")
    thirds = events.agg(F.max("event_id") + 1).scalar()
    due = F.floor(F.col("event_id") * ARRIVALS / thirds).cast("int")
    late = (F.col("event_id") % 10 == 7).cast("int")
    return events.select(
        F.col("event_type").alias("run_id"), F.col("event_id").alias("text_index"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("elapsed_s"), (F.col("value") > 5).alias("is_valid"),
        F.least(due + late, F.lit(ARRIVALS - 1)).alias("arrival"),
    )


def latency_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency per run and day, closed two days after; events that come later are counted apart."""
    log, path = materialize(_timed_events(spark, sf_dir), "window-log"), scratch_path(spark, "windows")

    def start(stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return W.append_windows(W.latency_windows(stream, "1 day", "2 days"), f"{path}/rows", checkpoint)

    _arrive(log, path, start)
    return W.with_late(spark.read.parquet(f"{path}/rows"), log, "1 day", "2 days").select(
        "run_id", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "responses",
        F.round("mean_s", 6).alias("mean_s"), "max_s", "late")


_LATENCY_WINDOWS = """WITH e AS (
  SELECT event_type AS run_id, ts, value, date_trunc('day', ts) AS day,
         least(CAST(floor(event_id * 3 / (SELECT max(event_id) + 1 FROM events)) AS INT)
               + CASE WHEN event_id % 10 = 7 THEN 1 ELSE 0 END, 2) AS arrival FROM events
), m AS (
  SELECT a.arrival, max(e.ts) - INTERVAL 2 DAY AS mark FROM (SELECT DISTINCT arrival FROM e) a
  JOIN e ON e.arrival < a.arrival GROUP BY a.arrival
), f AS (
  SELECT e.*, coalesce(day + INTERVAL 1 DAY <= mark, false) AS late FROM e LEFT JOIN m USING (arrival)
)
SELECT run_id, strftime(day, '%Y-%m-%d') AS day, count(*) FILTER (WHERE NOT late) AS responses,
  round(avg(value) FILTER (WHERE NOT late), 6) AS mean_s, max(value) FILTER (WHERE NOT late) AS max_s,
  count(*) FILTER (WHERE late) AS late
FROM f WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events) GROUP BY run_id, day"""


def progress_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress where every tenth event is delivered twice, the second time one arrival later."""
    log = _timed_events(spark, sf_dir)
    again = log.filter("text_index % 10 = 3").withColumn("arrival", F.least(F.col("arrival") + 1, F.lit(ARRIVALS - 1)))
    log, path = materialize(log.unionByName(again), "once-log"), scratch_path(spark, "once")
    totals = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("run_id")).agg(
        (F.count("*") + F.count_distinct("user_id")).alias("total"))
    schema = MON.progress(log, totals).schema

    def start(stream: DataFrame, checkpoint: str) -> StreamingQuery:
        state = MON.progress(W.once(stream, "60 days"), totals)
        return MON.write_updates(state, f"{path}/rows", checkpoint)

    _arrive(log, path, start)
    return MON.latest_updates(spark, f"{path}/rows", schema).select(
        "run_id", "processed", "valid", "invalid", "remaining", F.round("mean_s", 6).alias("mean_s"), F.round("eta_s", 3).alias("eta_s"))


def _registry_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run documents of 5 models and 12 methods; a (model, method) is measured again in some of the arrivals."""
    events = table(spark, sf_dir, "events").withColumns(
        {"method": F.concat(F.lit("M"), F.col("user_id") % 12), "arrival": (F.col("event_id") % ARRIVALS).cast("int")}
    ).filter((F.col("user_id") + F.col("arrival")) % 4 != 0)
    return events.groupBy(F.col("event_type").alias("model_key"), "method", "arrival").agg(
        F.count("*").alias("total_samples"), F.round(F.avg("value"), 6).alias("average_response_time_seconds"),
        F.min("value").alias("gpu_memory_during_inference_gb"),
    ).withColumn("timestamp", F.concat(F.lit("2025010"), F.col("arrival") + 1, F.lit("_1200")))


def registry_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry kept up from documents that arrive in three steps."""
    documents, path = materialize(_registry_documents(spark, sf_dir), "registry-documents"), scratch_path(spark, "registry")
    for number in range(ARRIVALS):
        part = documents.filter(F.col("arrival") == number).drop("arrival").withColumn("run_id", F.lit(f"r{number}"))
        T.write_documents(part, f"{path}/runs")
        REG.write_registry(REG.arriving_runs(spark, f"{path}/runs", "part-*"), f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return REG.registry(spark, f"{path}/rows").select(
        F.col("path_model").alias("model_key"), "method", "timestamp", "average_response_time_seconds", "gpu_memory_during_inference_gb")


_REGISTRY_STREAM = """WITH d AS (
  SELECT event_type AS model_key, 'M' || CAST(user_id % 12 AS VARCHAR) AS method, event_id % 3 AS arrival, value
  FROM events WHERE (user_id + event_id % 3) % 4 <> 0
), g AS (
  SELECT model_key, method, arrival, round(avg(value), 6) AS average_response_time_seconds,
         min(value) AS gpu_memory_during_inference_gb,
         row_number() OVER (PARTITION BY model_key, method ORDER BY arrival DESC) AS n FROM d GROUP BY model_key, method, arrival
)
SELECT model_key, method, '2025010' || CAST(arrival + 1 AS VARCHAR) || '_1200' AS timestamp,
  average_response_time_seconds, gpu_memory_during_inference_gb FROM g WHERE n = 1"""


QUERIES = {
    "guard_trips": (guard_trips, _GUARD_TRIPS),
    "latency_windows": (latency_windows, _LATENCY_WINDOWS),
    "progress_once": (progress_once, _PROGRESS),
    "registry_stream": (registry_stream, _REGISTRY_STREAM),
    "progress_stream": (progress_stream, _PROGRESS),
    "over_budget_stream": (
        over_budget_stream, "SELECT event_type AS run_id FROM events GROUP BY 1 HAVING avg(value) > 20"
    ),
    "processed_stream": (processed_stream, _PROCESSED),
}
