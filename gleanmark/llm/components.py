"""Connected components of a graph given as a table of links, by contraction in rounds."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanmark.session import materialize


def connected(links: DataFrame) -> DataFrame:
    """node, root of every node in ``links`` (a, b); the root is one node of the component, the same for all of it.

    In every round each node joins its smallest neighbour and the links are rewritten to the nodes they joined, which
    leaves at most half of the nodes that still have links. The rounds' tables are put together at the end. Minima are
    combined before the shuffle, so a node with very many links does not meet them in one task; each round is written
    to the shared folder.
    """
    open_links = materialize(links.where("a <> b").select("a", "b").distinct(), "links")
    rounds = []
    while not open_links.isEmpty() or not rounds:
        both = open_links.union(open_links.select("b", "a"))
        joins = materialize(
            both.groupBy(F.col("a").alias("from")).agg(F.min("b").alias("nearest"))
            .select("from", F.least("from", "nearest").alias("to")), "joins",
        )
        rounds.append(joins)
        left, right = joins.toDF("fa", "ta"), joins.toDF("fb", "tb")
        open_links = materialize(
            open_links.join(left, F.col("a") == F.col("fa")).join(right, F.col("b") == F.col("fb"))
            .where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(),
            "links",
        )
    # From the last round back, as each has at most half of the nodes of the one before.
    roots = rounds[-1].toDF("node", "root")
    for joins in reversed(rounds[:-1]):
        roots = joins.join(roots, F.col("to") == F.col("node"), "left").select(
            F.col("from").alias("node"), F.coalesce("root", "to").alias("root"))
    return materialize(roots, "roots")
