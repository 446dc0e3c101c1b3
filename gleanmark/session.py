"""Session settings and the shared folder for intermediate tables."""
from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from gleanmark.functions import jsonvalue as J

_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def prepare(spark: SparkSession) -> SparkSession:
    """Set the few session options the operators rely on, and let tasks import this package from where it lies.

    On a cluster whose machines do not share this folder, install the package
    or pass it with ``--py-files``.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    J.last_key_wins(spark)
    # Arrow batches of long texts must not fill a task's memory.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    tasks = spark.sparkContext.environment
    paths = [p for p in tasks.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        tasks["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's checkpoint folder, else its warehouse, which is shared too."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; ``<folder>/gleanmark`` can be removed when no query runs."""
    return f"{shared_folder(spark).rstrip('/')}/gleanmark/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Later steps then start from files that outlive any executor, and costly
    steps feeding several others run once.  The shuffle files of the write go
    when it is done.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_SHUFFLE_CLEANUP, "false")
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
