"""Latency by time windows, and responses that are delivered more than once.

A watermark follows the newest event time by a fixed delay.  A window is closed
and written once the watermark passes its end; state is kept for open windows
only.  What arrives for a closed window is late: it is not in the window's
figures, and counted apart by comparing the stored log with the windows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanmark.streaming.monitor import ONCE


def latency_windows(responses: DataFrame, length: str, delay: str, time: str = "ts") -> DataFrame:
    """run_id, window_start, window_end, responses, mean_s and max_s of every closed window of a stream.

    ``responses``: run_id, elapsed_s and an event time.  A response without a
    time of its own counts, its latency does not; one without an event time
    belongs to no window.
    """
    return _by_window(responses.filter(F.col(time).isNotNull()).withWatermark(time, delay), length, time).agg(
        F.count(F.lit(1)).alias("responses"), F.avg("elapsed_s").alias("mean_s"), F.max("elapsed_s").alias("max_s"),
    ).select("run_id", "window.start", "window.end", "responses", "mean_s", "max_s").withColumnsRenamed(
        {"start": "window_start", "end": "window_end"})


def _by_window(responses: DataFrame, length: str, time: str):
    return responses.groupBy(F.window(time, length).alias("window"), "run_id")


def append_windows(
    windows: DataFrame, path: str, checkpoint: str, trigger: dict[str, str | bool] = ONCE
) -> StreamingQuery:
    """Append closed windows to a parquet table; a restart neither repeats nor loses one."""
    return (
        windows.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def with_late(closed: DataFrame, log: DataFrame, length: str, delay: str, time: str = "ts") -> DataFrame:
    """``closed`` windows with ``late``: the log's responses that came after their window was closed.

    A window all of whose responses were late has 0 ``responses``.  ``log`` is
    the stored log that the stream has read to its end.
    """
    dated = log.filter(F.col(time).isNotNull())
    until = dated.agg((F.max(time) - F.expr(f"INTERVAL {delay}")).alias("until")).select("until").scalar()
    arrived = _by_window(dated, length, time).agg(F.count(F.lit(1)).alias("_arrived")).filter(
        F.col("window.end") <= until
    ).select(F.col("run_id").alias("_run"), F.col("window.start").alias("_start"), F.col("window.end").alias("_end"), "_arrived")
    same = F.col("_run").eqNullSafe(F.col("run_id")) & (F.col("_start") == F.col("window_start"))
    return arrived.join(closed, same, "left").select(
        F.col("_run").alias("run_id"), F.col("_start").alias("window_start"), F.col("_end").alias("window_end"),
        F.coalesce("responses", F.lit(0)).cast("bigint").alias("responses"), "mean_s", "max_s",
        (F.col("_arrived") - F.coalesce("responses", F.lit(0))).alias("late"),
    )


def once(responses: DataFrame, delay: str, time: str = "ts", keys: tuple[str, ...] = ("run_id", "text_index")) -> DataFrame:
    """A stream of responses without repeated deliveries.

    The first delivery of a text goes on; repetitions whose event time lies
    within ``delay`` are dropped, and a text's state goes when the watermark is
    past it.  Without a stream, repetitions go whenever they came.
    """
    if not responses.isStreaming:
        return responses.dropDuplicates(list(keys))
    return responses.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))
