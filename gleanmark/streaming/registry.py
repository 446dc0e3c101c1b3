"""The run registry kept up from documents as they arrive.

A file stream reads every document once.  The state holds one row for each
(model, method): the columns of its newest document, by the time and name of
its file, never the text.  Every batch writes the rows that changed.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanmark.operators.runs import latest_runs
from gleanmark.sources.tables import document_files, parsed_documents
from gleanmark.streaming.monitor import ONCE, write_updates

_KEYS = ("path_model", "method")


def arriving_runs(spark: SparkSession, root: str, pattern: str = "metrics_*.json", files_a_batch: int = 10_000) -> DataFrame:
    """The newest document of every (model, method) below ``root``, as a stream; columns as ``tables.read_runs``."""
    files = (
        spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_a_batch).text(root, wholetext=True)
    )
    return latest_runs(parsed_documents(document_files(files)), by=_KEYS)


def write_registry(runs: DataFrame, path: str, checkpoint: str, trigger: dict[str, str | bool] = ONCE) -> StreamingQuery:
    """Write the rows that changed in each batch; a repeated batch overwrites its own folder."""
    return write_updates(runs, path, checkpoint, trigger)


def registry(spark: SparkSession, path: str) -> DataFrame:
    """The newest document of every (model, method), of all batches written so far."""
    return latest_runs(spark.read.parquet(path).drop("batch_id"), by=_KEYS)


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Write the registry as one table, so that the folders of its batches can go."""
    registry(spark, path).write.mode("overwrite").parquet(target)
