"""Mixing sources to target weights with a low-discrepancy schedule.

The documents of a source, shuffled by a hash of their id, form a stream of words that is cut into blocks of equal
numbers of words; it starts over when it ends. Slots of the mix are points of the golden-ratio sequence mapped through
the cumulative numbers of blocks that the sources need. Ranking a source's slots gives the block that each slot takes.
Slots beyond a source's need are dropped, and blocks that got no slot follow at the end, so every source takes exactly
the whole words of its target.

Running sums are made in two steps, within hash buckets and over bucket totals, so that no task holds a whole source.
Only tables with one row for each source or bucket total meet in one task.

Null and empty texts have size 0 and are never taken. A null source is a source of its own and comes last. Repeated
rows are documents of their own. Rows with a null id come first in the shuffle.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from gleanmark.llm import arrays as A
from gleanmark.llm.frames import free_name, running_start
from gleanmark.session import materialize

BLOCK_WORDS = 256
CYCLE = 1 << 31
GOLDEN_STEP = 1327217885          # odd number nearest to CYCLE times the golden section 0.618...
SLOTS_PER_GROUP = 1 << 13


def word_count(text: str) -> Column:
    """Number of words of a text column; 0 for null."""

    @arrow_udf("bigint")
    def n_words(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            parts = [np.diff(A.words(p).first) for p in A.pieces(column)]
            yield pa.array(np.concatenate(parts or [np.zeros(0)]).astype(np.int64))

    return n_words(text)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """source, source_size, target and weight of every source; one row per source.

    Together the targets are ``share`` of all sizes, by weight; a target stops at ``most`` times the source's size and
    the excess goes to the others by weight. That is min(level * weight, cap) with the level at which the sum is right.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*map(F.lit, weights))
    weighted = total.select(
        "source", "source_size",
        F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long").alias("weight"),
    ).withColumn("cap", most * F.col("source_size"))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    )
    leveled = weighted.select("*", level.alias("level"))
    # With the sources in order of cap / weight, the level rises while full ones are set aside and falls after that.
    return leveled.select(
        "source", "source_size", "weight",
        F.least(F.col("cap").cast("double"), F.max("level").over(everything) * F.col("weight")).alias("target"),
    )


def schedule(goals: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """slot, source, rank: which block of which source's stream each slot of the mix takes.

    ``goals`` has one row per source with ``quota`` (words to take) and should be a written table.
    """
    spark = goals.sparkSession
    need = F.ceil(F.col("quota") / block).cast("long")
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranges = goals.where("quota > 0").select("source", need.alias("need")).select(
        "source", "need", (F.sum("need").over(by_name.rowsBetween(Window.unboundedPreceding, 0)) - F.col("need")).alias("lo")
    ).withColumn("hi", F.col("lo") + F.col("need"))
    n, n_sources = ranges.agg(F.coalesce(F.sum("need"), F.lit(0)), F.count("*")).first()
    i = F.col("slot")
    point = ((i % CYCLE) * GOLDEN_STEP + F.floor(i / CYCLE) * 7) % CYCLE / CYCLE
    cells = 4 * max(n_sources, 16)
    slots = spark.range(n).select(F.col("id").alias("slot")).withColumn("place", point * n)
    slots = slots.withColumn("cell", F.floor(F.col("place") / max(n, 1) * cells))
    covered = ranges.withColumn("cell", F.explode(F.sequence(
        F.greatest(F.lit(0), F.floor(F.col("lo") / max(n, 1) * cells) - 1),
        F.least(F.lit(cells), F.floor(F.col("hi") / max(n, 1) * cells) + 1),
    )))
    dealt = slots.join(covered, "cell").where("place >= lo and place < hi").select("slot", "source", "need")
    dealt = materialize(dealt.withColumn("slots", F.floor(i / SLOTS_PER_GROUP)), "mix-slots")
    ranked = running_start(dealt, "source", "slots", ["slot"], None).withColumnRenamed("start", "rank")
    got = dealt.groupBy("source").agg(F.count("*").alias("got"))
    short = ranges.join(got.withColumnRenamed("source", "g"), F.col("source").eqNullSafe(F.col("g")), "left").select(
        "source", "lo", F.coalesce("got", F.lit(0)).alias("got"), "need"
    ).where("got < need")
    late = short.select((F.lit(n) + F.col("lo")).alias("lo"), "source", "got",
                        F.explode(F.sequence("got", F.col("need") - 1)).alias("rank"))
    return ranked.where("rank < need").select("slot", "source", "rank").unionByName(
        late.select((F.col("lo") + F.col("rank")).alias("slot"), "source", "rank")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2,
        block: int = BLOCK_WORDS, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns, source, size, source_size, target, taken, first_slot and n_slots of every row of ``docs``
    (doc_id, source, text).

    Slots are places in the order of the mix: ``n_slots`` slots hold words of the document, ``first_slot`` the first of
    them, null where none is taken.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = materialize(
        docs.select(*carry, "source", word_count("text").alias("size"), key.alias("key"))
        .withColumn("bucket", F.substring("key", 1, 3)), "mix-sizes",
    )
    goals = materialize(
        targets(sized, weights, share, most).withColumn("quota", F.floor("target").cast("long")), "mix-targets"
    )
    taken = pieces_taken(sized, goals, schedule(goals, block), block, carry)
    return taken.select(*carry, "source", "size", "source_size", "target", "taken", "first_slot", "n_slots")


def pieces_taken(sized: DataFrame, goals: DataFrame, slots: DataFrame, block: int, carry: tuple[str, ...]) -> DataFrame:
    """Words of each document that lie in blocks which a slot takes, first and repeated passes together; and the slots."""
    order = ["key", *carry, "size"]
    placed = running_start(sized, "source", "bucket", order, "size")
    known = goals.select(F.col("source").alias("g"), "source_size", "target", "quota")
    placed = placed.join(known, F.col("source").eqNullSafe(F.col("g"))).drop("g")
    none = F.lit(0).cast("long")
    empty = placed.where("size = 0").withColumns({"taken": none, "first_slot": F.lit(None).cast("long"), "n_slots": none})
    filled = placed.where("size > 0")
    passes = filled.withColumn("pass", F.explode(F.sequence(F.lit(0), F.greatest(
        F.lit(0), F.ceil(F.col("quota") / F.col("source_size")).cast("int") - 1))))
    begin = F.col("start") + F.col("pass") * F.col("source_size")
    cut = passes.withColumn("begin", begin).withColumn(
        "end", F.greatest("begin", F.least(F.col("begin") + F.col("size"), F.col("quota")))
    )
    blocks = cut.withColumn("piece", F.explode_outer(F.when(
        F.col("end") > F.col("begin"),
        F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block)),
    )))
    words = F.least("end", (F.col("piece") + 1) * block) - F.greatest("begin", F.col("piece") * block)
    taken_slots = slots.select(F.col("source").alias("s"), F.col("rank").alias("r"), "slot")
    joined = blocks.withColumn("words", words).join(
        taken_slots, F.col("source").eqNullSafe(F.col("s")) & (F.col("piece") == F.col("r")), "left"
    )
    keep = [*carry, "source", "size", "source_size", "target", "start"]
    summed = joined.groupBy(*keep).agg(
        F.coalesce(F.sum(F.when(F.col("r").isNotNull(), F.col("words"))), F.lit(0)).cast("long").alias("taken"),
        F.min("slot").alias("first_slot"), F.count("slot").alias("n_slots"),
    )
    return summed.unionByName(empty.select(*keep, "taken", "first_slot", "n_slots"))


def repeated(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: a row for every pass that takes words of the document, with its whole text.

    The one document of a source in which the target ends is kept whole. Texts move once, to be joined to their number
    of copies; identical rows add up their copies.
    """
    key, copies, nth, of = (free_name(docs, w) for w in ("mix_key", "mix_copies", "mix_nth", "mix_of"))
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "source", "text"))
    taken = mix(keyed.select("doc_id", "source", "text", F.col(key).alias("mix_key")), carry=("doc_id", "mix_key"), **options)
    times = taken.where("taken > 0").groupBy(F.col("mix_key").alias(of)).agg(
        F.sum(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias(copies))
    first = Window.partitionBy(key).orderBy(key)
    joined = keyed.join(times, F.col(key) == F.col(of)).withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1)
    return joined.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
