import hashlib
import math
from collections import defaultdict

import pytest

from gleanmark.llm import mixing


def size(text):
    return len((text or "").split())


def water_fill(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def check(rows, texts):
    sizes = defaultdict(int)
    for _id, source, text in texts:
        sizes[source] += size(text)
    goals = water_fill(sizes)
    assert len(rows) == len(texts)
    taken = defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(goals[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for source, goal in goals.items():
        assert taken[source] == math.floor(goal + 1e-9) or abs(taken[source] - goal) < 1.001


def test_targets_and_words(spark, some_documents, odd_documents):
    for docs in (some_documents, odd_documents):
        texts = [tuple(r) for r in docs.select("doc_id", "source", "text").collect()]
        check(mixing.mix(docs).collect(), texts)
        check(mixing.mix(docs, block=7).collect(), texts)


def test_order_of_the_stream(some_documents):
    rows = mixing.mix(some_documents).collect()
    by_source = defaultdict(list)
    for r in rows:
        by_source[r["source"]].append(r)
    for own in by_source.values():
        own.sort(key=lambda r: (hashlib.md5(str(r["doc_id"]).encode()).hexdigest(), r["doc_id"]))
        start, quota, total = 0, math.floor(own[0]["target"]), own[0]["source_size"]
        for r in own:
            first = min(r["size"], max(0, quota - start))
            again = min(r["size"], max(0, quota - total - start))
            assert r["taken"] == first + again
            start += r["size"]


def test_schedule_is_even(spark):
    goals = spark.createDataFrame([("a", 64_000), ("b", 32_000), (None, 16_000), ("e", 0)], "source string, quota long")
    slots = sorted(mixing.schedule(goals, 16).collect())
    assert len({s["slot"] for s in slots}) == len(slots) == 7000
    ranks = defaultdict(list)
    for s in slots:
        ranks[s["source"]].append(s["rank"])
    assert {k: len(v) for k, v in ranks.items()} == {"a": 4000, "b": 2000, None: 1000}
    assert all(v == list(range(len(v))) for v in ranks.values())
    for n in range(100, 7000, 100):
        share = sum(s["source"] == "a" for s in slots[:n])
        assert abs(share - n * 4 / 7) < 8


def test_copies(spark, odd_documents, no_documents):
    taken = {(r["doc_id"], r["size"]): r["taken"] for r in mixing.mix(odd_documents).collect()}
    out = mixing.repeated(odd_documents)
    assert out.columns == odd_documents.columns
    rows = out.collect()
    assert all(size(r["text"]) for r in rows)
    for (doc_id, n), words in taken.items():
        if doc_id in (7, 8, 13):
            assert sum(r["doc_id"] == doc_id for r in rows) == math.ceil(words / n)
    assert mixing.mix(no_documents).count() == 0 and mixing.repeated(no_documents).count() == 0
    empty = spark.createDataFrame([(1, "s", ""), (2, None, None)], "doc_id long, source string, text string")
    assert [r["taken"] for r in mixing.mix(empty).collect()] == [0, 0]


def test_slots_of_the_mix_follow_the_shares(spark, monkeypatch):
    """Every prefix of the slots holds each source near its share of all, and another sequence gives another result."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs, block=16).collect()
    assert all((r["first_slot"] is None) == (r["taken"] == 0) == (r["n_slots"] == 0) for r in rows)
    goals = spark.createDataFrame(
        list({(r["source"], math.floor(r["target"])) for r in rows}), "source string, quota bigint")
    slots = sorted((r["slot"], r["source"]) for r in mixing.schedule(goals, 16).collect())
    total = len(slots)
    share = defaultdict(int)
    for _slot, source in slots:
        share[source] += 1
    held = defaultdict(int)
    for n, (_slot, source) in enumerate(slots, 1):
        held[source] += 1
        if n % 97 == 0:
            assert all(abs(held[s] - n * share[s] / total) < 25 for s in share), n
    first = {r["doc_id"]: r["first_slot"] for r in rows}
    assert min(v for v in first.values() if v is not None) == slots[0][0]
    monkeypatch.setattr(mixing, "GOLDEN_STEP", 1)
    plain = {r["doc_id"]: r["first_slot"] for r in mixing.mix(docs, block=16).collect()}
    assert sum(plain[i] != first[i] for i in first) > 0.9 * sum(v is not None for v in first.values())
