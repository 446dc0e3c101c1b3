"""The time guard of a run as it works while responses arrive: sticky, in the order of the texts.

Before every text the mean time of the responses so far is compared with the
limit, and a run that exceeds it is given up there, even if later responses
would bring the mean down again.  Responses carry their position in the run,
from 0 without gaps.  They may arrive in any order, cut into any batches, and
more than once; a response waits in the run's state until all before it are
there, and the part of a run behind a gap does not count yet.

Times are whole microseconds, so sums do not depend on order.  A response
without a time counts as processed and leaves the mean alone.  Rows without a
run or a position are left out.  The stream and its batch twin give the same rows.
"""
from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gleanmark.plans.ranks import running_totals
from gleanmark.streaming.monitor import TIME_LIMIT_SECONDS

# Ship the processor with the tasks: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Rows of one run that are put in order at a time; what still waits after that goes to the state.
_SORTED_ROWS = 50_000
_STATE = "next bigint, timed bigint, total_us bigint, last_index bigint, trip_timed bigint, trip_us bigint"


def microseconds(seconds: Column) -> Column:
    return F.round(seconds * 1_000_000).cast("bigint")


class _Guard(StatefulProcessor):
    """State of a run: the totals up to the first gap, where it tripped, and responses that wait behind a gap."""

    def __init__(self, limit_us: int) -> None:
        self.limit_us = limit_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.reached = handle.getValueState("reached", _STATE)
        self.waiting = handle.getMapState("waiting", "position bigint", "us bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = list(self.reached.get()) if self.reached.exists() else [0, 0, 0, None, None, None]
        part: dict[int, int | None] = {}
        for row in rows:
            if row.position >= state[0]:
                part[row.position] = row.us
            if len(part) >= _SORTED_ROWS:
                self._advance(state, part)
        self._advance(state, part)
        while self.waiting.containsKey((state[0],)):
            position = state[0]
            self._step(state, self.waiting.getValue((position,))[0])
            self.waiting.removeKey((position,))
        self.reached.update(tuple(state))
        yield Row(run_id=key[0], next=state[0], last_index=state[3], trip_timed=state[4], trip_us=state[5])

    def _advance(self, state: list, part: dict[int, int | None]) -> None:
        for position in sorted(part):
            if position == state[0]:
                self._step(state, part[position])
            else:
                self.waiting.updateValue((position,), (part[position],))
        part.clear()

    def _step(self, state: list, us: int | None) -> None:
        if us is not None:
            state[1] += 1
            state[2] += us
        if state[3] is None and state[2] > self.limit_us * state[1]:
            state[3:] = [state[0], state[1], state[2]]
        state[0] += 1

    def close(self) -> None:
        pass


_OUTPUT = "run_id string, next bigint, last_index bigint, trip_timed bigint, trip_us bigint"


def _prepared(responses: DataFrame) -> DataFrame:
    return responses.select(
        F.col("run_id").cast("string").alias("run_id"), F.col("position").cast("bigint").alias("position"),
        microseconds(F.col("elapsed_s")).alias("us"),
    ).filter(F.col("run_id").isNotNull() & (F.col("position") >= 0))


def guard_states(responses: DataFrame, limit_s: float = TIME_LIMIT_SECONDS) -> DataFrame:
    """The guard of every run that changed, of a stream of responses (run_id, position, elapsed_s).

    Written with ``monitor.write_updates`` and read with ``monitor.latest_updates``.
    """
    responses.sparkSession.conf.set(_STORE, _ROCKS)
    return _prepared(responses).groupBy("run_id").transformWithState(
        statefulProcessor=_Guard(round(limit_s * 1_000_000)), outputStructType=T.StructType.fromDDL(_OUTPUT),
        outputMode="Update", timeMode="None",
    )


def guard_states_of_log(responses: DataFrame, limit_s: float = TIME_LIMIT_SECONDS) -> DataFrame:
    """The same states from a whole log, by running totals; no task holds a whole run."""
    once = _prepared(responses).groupBy("run_id", "position").agg(F.max("us").alias("us"))
    limit = round(limit_s * 1_000_000)
    rows = running_totals(
        once, ["run_id"], "position",
        {"processed": F.lit(1), "timed": F.when(F.col("us").isNotNull(), 1).otherwise(0), "total": F.coalesce("us", F.lit(0))},
    ).filter(F.col("processed") == F.col("position") + 1)
    over = F.col("total") > F.col("timed") * limit
    first = F.min(F.when(over, F.struct("position", "timed", "total"))).alias("_trip")
    return rows.groupBy("run_id").agg(F.max("processed").alias("next"), first).select(
        "run_id", "next", F.col("_trip.position").alias("last_index"), F.col("_trip.timed").alias("trip_timed"),
        F.col("_trip.total").alias("trip_us"),
    )


def guard_trips(states: DataFrame, totals: DataFrame) -> DataFrame:
    """run_id, last_index, mean_s and responses_after of the runs that were given up.

    ``totals`` is a table (run_id, total): a run that exceeds the limit with its
    last text has no text to give up.  ``last_index`` is the last text
    processed, ``responses_after`` counts responses that came all the same.
    """
    known = totals.select(F.col("run_id").cast("string").alias("run_id"), F.col("total").cast("bigint").alias("total"))
    return states.filter(F.col("last_index").isNotNull()).join(known, "run_id").filter(
        F.col("last_index") + 1 < F.col("total")
    ).select(
        "run_id", "last_index", (F.col("trip_us") / F.col("trip_timed") / 1_000_000).alias("mean_s"),
        (F.col("next") - F.col("last_index") - 1).alias("responses_after"),
    )
