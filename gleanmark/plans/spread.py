"""Bounded tasks for costly row-wise work."""
from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of costly row-wise work in one task.
TASK_ROWS = 50_000


def spread(df: DataFrame, rows: int = TASK_ROWS, by: str | None = None) -> DataFrame:
    """Spread a table over all cores, in tasks of about ``rows`` rows, before costly row-wise work.

    A packed file split holds millions of rows, so a task's work is bounded by
    rows; they are counted from the file footers.  A table with as many splits
    is left where it is.  With ``by`` the rows are dealt by that column, so that
    joins and groupings on it need no other shuffle and keep the small tasks.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    if by is not None:
        return df.repartition(tasks, by)
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)
