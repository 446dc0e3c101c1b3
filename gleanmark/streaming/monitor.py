"""Monitoring of an arriving response log with Structured Streaming."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

# Fixed value: mean seconds per response after which a run is given up.
TIME_LIMIT_SECONDS = 20 * 60.0
# All input that is there, then stop.
ONCE = {"availableNow": True}


def progress(responses: DataFrame, totals: DataFrame) -> DataFrame:
    """Processed, valid and invalid responses, mean latency, remaining and ETA per run.

    Works on batch and streaming tables.  The state is one row per run.
    ``totals`` is a table (run_id, total): the number of texts of each run.
    """
    counted = responses.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if("is_valid").alias("valid"),
        F.count_if(~F.col("is_valid")).alias("invalid"),
        F.coalesce(F.avg("elapsed_s"), F.lit(0.0)).alias("mean_s"),
    )
    known = totals.select("run_id", F.col("total").cast("bigint").alias("total"))
    return counted.join(known, "run_id", "left").withColumn(
        "remaining",
        F.when(F.col("total").isNotNull(), F.greatest(F.col("total") - F.col("processed"), F.lit(0))),
    ).withColumn("eta_s", F.col("mean_s") * F.col("remaining"))


def over_budget(progressed: DataFrame, limit_s: float = TIME_LIMIT_SECONDS) -> DataFrame:
    """Runs whose mean latency exceeds the limit."""
    return progressed.filter(F.col("mean_s") > limit_s)


def write_updates(
    progressed: DataFrame, path: str, checkpoint: str, trigger: dict[str, str | bool] = ONCE
) -> StreamingQuery:
    """Write each batch of changed runs to a folder of its own.

    ``trigger`` is what Structured Streaming takes, for example
    ``{"processingTime": "1 minute"}`` for a log that goes on arriving.  A batch that is repeated after a failure overwrites its own folder.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        progressed.writeStream.outputMode("update").foreachBatch(save)
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def latest_updates(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The last written state of every run."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])).parquet(path)
    return rows.groupBy(F.col("run_id").alias("_run")).agg(
        F.max_by(F.struct(*schema.names), F.col("batch_id")).alias("_last")
    ).select("_last.*")


def append_processed(
    processed: DataFrame, path: str, checkpoint: str, trigger: dict[str, str | bool] = ONCE
) -> StreamingQuery:
    """Append salvaged and validated responses to a parquet table."""
    return (
        processed.drop("record").writeStream.outputMode("append").format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**trigger).start()
    )
