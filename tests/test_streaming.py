"""Stateful monitoring: the time guard, windows with late rows, repeated deliveries, the registry; repeatable writes."""
import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from gleanmark.sources import tables as T
from gleanmark.streaming import guard as G
from gleanmark.streaming import monitor as MON
from gleanmark.streaming import registry as REG
from gleanmark.streaming import windows as W

LOG = "run_id string, position bigint, elapsed_s double"


def in_batches(spark, tmp_path, batches, schema, start):
    """Let the batches arrive one after the other; the stream goes on from its checkpoint."""
    root = tmp_path / uuid.uuid4().hex
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/log")
        start(spark.readStream.schema(schema).parquet(f"{root}/log"), f"{root}/rows", f"{root}/checkpoint").awaitTermination()
    return f"{root}/rows"


def plain_trips(rows, limit):
    """The loop that the guard stands for."""
    out, runs = {}, {}
    for run, position, s in rows:
        if run is not None and position is not None:
            runs.setdefault(run, {})[position] = s
    for run, held in runs.items():
        times, trip = [], None
        for i in range(len(held)):
            if i not in held:
                break
            if trip is None and times and sum(times) / len(times) > limit:
                trip = (i - 1, round(sum(times) / len(times), 6))
            if held[i] is not None:
                times.append(held[i])
        if trip:
            out[run] = (*trip, i - trip[0])
    return out


def trips(states, rows):
    totals = states.sparkSession.createDataFrame([(r, len({p for q, p, _ in rows if q == r})) for r in {r for r, _p, _s in rows if r}], "run_id string, total bigint")
    return {r.run_id: (r.last_index, round(r.mean_s, 6), r.responses_after) for r in G.guard_trips(states, totals).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_guard_is_sticky_and_the_same_for_any_cut(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [("recovers", i, s) for i, s in enumerate([1.0, 30.0, 1.0, 1.0, 1.0])]
    rows += [("last text", i, s) for i, s in enumerate([1.0, 1.0, 90.0])]
    rows += [("never", i, 10.0) for i in range(6)]
    rows += [("first", i, s) for i, s in enumerate([None, 11.0, None, 2.0])]
    rows += [(f"r{k}", i, rng.choice([None, *[round(rng.expovariate(0.1), 3)] * 4])) for k in range(6) for i in range(rng.randint(1, 30))]
    wanted = plain_trips(rows, 10.0)
    assert wanted["recovers"] == (1, 15.5, 3) and "last text" not in wanted and wanted["first"] == (1, 11.0, 2)
    batch = G.guard_states_of_log(spark.createDataFrame([*rows, (None, 1, 1.0), ("x", None, 99.0)], LOG), 10.0)
    assert trips(batch, rows) == wanted
    delivered = rows + rng.sample(rows, 15)
    rng.shuffle(delivered)
    cuts = sorted(rng.sample(range(len(delivered)), 3))
    batches = [delivered[a:b] for a, b in zip([0, *cuts], [*cuts, len(delivered)], strict=True)]
    start = lambda stream, path, checkpoint: MON.write_updates(G.guard_states(stream, 10.0), path, checkpoint)
    path = in_batches(spark, tmp_path, batches, LOG, start)
    states = MON.latest_updates(spark, path, batch.schema)
    key = lambda df: sorted(map(str, df.collect()))
    assert trips(states, rows) == wanted
    assert key(states.select(*batch.columns)) == key(batch.filter("run_id <> 'x'"))


def test_guard_waits_behind_a_gap_and_sorts_in_parts(spark, tmp_path, monkeypatch):
    start = lambda stream, path, checkpoint: MON.write_updates(G.guard_states(stream, 10.0), path, checkpoint)
    first = [("a", i, 50.0) for i in (4, 3, 2)]
    path = in_batches(spark, tmp_path, [first], LOG, start)
    assert [tuple(r)[:3] for r in spark.read.parquet(path).select("run_id", "next", "last_index").collect()] == [("a", 0, None)]
    path = in_batches(spark, tmp_path, [first, [("a", 0, 1.0)], [("a", 1, 1.0)]], LOG, start)
    last = MON.latest_updates(spark, path, G.guard_states_of_log(spark.createDataFrame([], LOG)).schema).first()
    assert (last.next, last.last_index) == (5, 2)
    monkeypatch.setattr(G, "_SORTED_ROWS", 2)
    assert G.guard_states_of_log(spark.createDataFrame([], LOG)).count() == 0


TIMED = "run_id string, text_index bigint, ts string, elapsed_s double"


def timed(stream):
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def test_windows_close_and_late_rows_are_counted_apart(spark, tmp_path):
    day = lambda d, h=0: f"2024-01-{d:02d} {h:02d}:00:00"
    first = [("a", 1, day(1), 2.0), ("a", 2, day(1, 23), 4.0), ("b", 1, day(2), 1.0), ("a", 3, day(6), 9.0), ("a", 9, None, 1.0)]
    second = [("a", 4, day(1, 5), 100.0), ("b", 2, day(3), 100.0), ("a", 5, day(5), None), (None, 1, day(9), 3.0), ("b", 3, day(12), 1.0)]
    start = lambda stream, path, checkpoint: W.append_windows(W.latency_windows(timed(stream), "1 day", "1 day"), path, checkpoint)
    path = in_batches(spark, tmp_path, [first, second], TIMED, start)
    log = timed(spark.createDataFrame(first + second, TIMED))
    got = {(r.run_id, r.window_start.day): (r.responses, r.mean_s, r.max_s, r.late)
           for r in W.with_late(spark.read.parquet(path), log, "1 day", "1 day").collect()}
    assert got == {
        ("a", 1): (2, 3.0, 4.0, 1), ("b", 2): (1, 1.0, 1.0, 0), ("b", 3): (0, None, None, 1), ("a", 5): (1, None, None, 0),
        ("a", 6): (1, 9.0, 9.0, 0), (None, 9): (1, 3.0, 3.0, 0),
    }
    assert spark.read.parquet(path).count() == 5


def test_repeated_deliveries_count_once(spark, tmp_path):
    rows = [("a", i, f"2024-01-{1 + i:02d} 00:00:00", float(i)) for i in range(9)]
    batches = [rows[:5], rows[3:7], rows[6:] + rows[5:6]]
    path = in_batches(spark, tmp_path, batches, TIMED, lambda s, p, c: W.once(timed(s), "30 days").writeStream.outputMode("append")
                      .format("parquet").option("path", p).option("checkpointLocation", c).trigger(**MON.ONCE).start())
    assert sorted(r.text_index for r in spark.read.parquet(path).collect()) == list(range(9))
    assert W.once(spark.createDataFrame(sum(batches, []), TIMED), "1 day").count() == 9


def test_registry_follows_the_files(spark, tmp_path):
    root, out = tmp_path / "runs", str(tmp_path / "registry")

    def put(model, method, name, seconds, mtime):
        folder = root / model / method
        folder.mkdir(parents=True, exist_ok=True)
        doc = folder / name
        doc.write_text(json.dumps({"model_key": model, "timestamp": name, "average_response_time_seconds": seconds}, indent=1))
        import os
        os.utime(doc, (mtime, mtime))

    arrivals = [[("m", "A", "metrics_1.json", 1, 100), ("m", "B", "metrics_1.json", 2, 100)],
                [("m", "A", "metrics_2.json", 3, 200), ("n", "A", "metrics_1.json", 4, 150)],
                [("m", "A", "metrics_0.json", 5, 50), ("m", "B", "metrics_9.json", 6, 300), ("n", "A", "other.json", 7, 999)]]
    for arrival in arrivals:
        for doc in arrival:
            put(*doc)
        REG.write_registry(REG.arriving_runs(spark, str(root)), out, str(tmp_path / "checkpoint")).awaitTermination()
        key = lambda df: sorted((r.path_model, r.method, r.timestamp, r.average_response_time_seconds) for r in df.collect())
        assert key(REG.registry(spark, out)) == key(T.read_runs(spark, str(root)))
    assert key(REG.registry(spark, out)) == [("m", "A", "metrics_2.json", 3.0), ("m", "B", "metrics_9.json", 6.0), ("n", "A", "metrics_1.json", 4.0)]
    REG.compact(spark, out, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 3


def test_writing_a_run_again_replaces_it(spark, tmp_path):
    root = str(tmp_path / "out")
    responses = lambda run, texts: spark.createDataFrame([(run, "m/x", "A B", t, "{}") for t in texts],
                                                         "run_id string, model_key string, method string, text string, json_parsed string")
    T.write_responses(responses("r1", ["a", "b"]), root + "/responses")
    T.write_responses(responses("r2", ["c"]), root + "/responses")
    T.write_responses(responses("r1", ["d"]), root + "/responses")
    assert sorted((r.run_id, r.text) for r in T.read_responses(spark, root + "/responses").collect()) == [("r1", "d"), ("r2", "c")]

    documents = lambda n: spark.createDataFrame([("r1", "m", "A", n), ("r2", "m", "A", n)], "run_id string, model_key string, method string, total bigint")
    errors = lambda rows: spark.createDataFrame(rows, "run_id string, text_index bigint, errors array<string>")
    T.write_runs(documents(1), errors([("r1", 1, ["x"]), ("r2", 1, ["y"])]), root)
    T.write_runs(documents(2), errors([("r2", 5, ["z"])]), root)
    assert sorted((r.run_id, r.total) for r in spark.read.json(root + "/runs").collect()) == [("r1", 2), ("r2", 2)]
    assert [(r.run_id, r.text_index) for r in T.read_run_errors(spark, root).collect()] == [("r2", 5)]
    T.write_runs(documents(3), errors([]), root, rescored=True)
    assert spark.read.json(root + "/runs").count() == 4
