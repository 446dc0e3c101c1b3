import random

import numpy as np
import pyarrow as pa
import pytest

from gleanmark.llm import families, jaccard_join, pairs
from gleanmark.llm.arrays import mix, pieces
from gleanmark.llm.jaccard_join import Rule, Sets, signatures

from . import brute

NONE = np.zeros(0, np.int64)


def expected(docs, rule):
    rows = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    sets = {i: brute.word_shingles(t, rule.words) for i, t in rows.items()}
    roots, links = brute.components(sets, rule.percent)
    return {i: (len(sets[i]), roots[i]) for i in sets}, links


@pytest.mark.parametrize("rule", [Rule(4, 85), Rule(5, 80), Rule(2, 50)])
def test_given_documents(spark, rule):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar(docs, rule).collect()}
    wanted, links = expected(docs, rule)
    assert links > 50 and found == wanted


def near_copies(n, seed, words=120):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(6)):
            own[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("paired", [0, 3, 32])
def test_large_buckets_go_on_in_blocks(spark, monkeypatch, paired):
    monkeypatch.setattr(families, "BLOCK", 16)
    monkeypatch.setattr(pairs, "PAIRED", paired)
    texts = near_copies(150, 1) + near_copies(90, 2, 60) + near_copies(40, 3, 12)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rule = Rule(4, 85)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar(docs, rule).collect()}
    assert found == expected(docs, rule)[0]


def much_alike(n, seed, words=100, own=30):
    """Sets that share most of their shingles and do not link."""
    rng = random.Random(seed)
    base = [f"m{rng.randrange(10**6)}" for _ in range(words)]
    return [" ".join(base[: words - own] + [f"y{rng.randrange(10**7)}" for _ in range(own)]) for _ in range(n)]


def test_pairs_compared_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    """Copies are compared about once each, sets that are much alike only where they met in small buckets."""
    sent = []
    compared = pairs.compared

    def counted(rows, *rest):
        sent.append(rows.count())
        return compared(rows, *rest)

    monkeypatch.setattr(pairs, "compared", counted)
    for n in (300, 1200):
        sent.clear()
        texts = near_copies(n, 5) + much_alike(n, 6)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
        rows = jaccard_join.similar(docs, Rule(4, 85)).collect()
        assert {r["component_id"] for r in rows if r["doc_id"] < n} <= {r["doc_id"] for r in rows if r["doc_id"] < n}
        assert all(r["component_id"] == r["doc_id"] for r in rows if r["doc_id"] >= n)
        assert sum(sent) < 40 * n, (n, sent)
    wanted = expected(docs, Rule(4, 85))[0]
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == wanted


def test_buckets_are_the_same_however_entries_are_combined(spark):
    rng = np.random.default_rng(3)
    key, node = rng.integers(0, 40, 3000), rng.integers(0, 1 << 62, 300)[rng.integers(0, 300, 3000)]
    probe = (node + key) % 23 == 0                       # a set looks a key up wherever its text stands
    wanted = {}
    for k in np.unique(key):
        nodes = set(node[key == k].tolist())
        if probe[key == k].any() and len(nodes) > 1:
            wanted[int(k)] = nodes
    for parts, hot_run in ((1, 2), (7, 2), (7, 8), (40, 2), (300, 16)):
        batches = [pairs.combined(key[i::parts], node[i::parts], probe[i::parts], hot_run) for i in range(parts)]
        rows = [tuple(r.values()) for b in batches for r in b.to_pylist()]
        met = pairs.buckets(spark.createDataFrame(rows, pairs.ENTRIES).repartition(4)).collect()
        found = {}
        for r in met:
            found.setdefault(r.key, set()).update((r.a, r.b))
        assert found == wanted
        for k, nodes in wanted.items():                  # the centres of a bucket hang together
            roots = brute.Forest((x, x) for x in nodes)
            for r in met:
                if r.key == k:
                    roots.join(r.a, r.b)
            assert len({roots.root(x) for x in nodes}) == 1


def test_every_allocation_meets():
    """Any two linked sets meet, also when the costs forbid the segments they share."""
    rng, rule = np.random.default_rng(4), Rule(3, 80)
    for _ in range(150):
        words = rng.integers(0, 10**6, rng.integers(3, 160)).astype(str).tolist()
        other = list(words)
        for _ in range(rng.integers(0, 1 + len(words) // 25)):
            at = rng.integers(len(other) + 1)
            other[at : at + rng.integers(2)] = [str(rng.integers(10**6))]
        (piece,) = pieces(pa.array([" ".join(words), " ".join(other)]), 1 << 30)
        sets = Sets(piece, rule.words)
        same = len(np.intersect1d(sets.values[: sets.n[0]], sets.values[sets.n[0] :]))
        if 100 * same < rule.percent * (sets.n.sum() - same):
            continue
        low, high = np.argsort(sets.n, kind="stable")[[0, -1]]
        band = rule.band(sets.n[[low]])
        shared = np.intersect1d(*(signatures(sets, np.array([i]), band, rule, NONE, NONE, True)[0] for i in (low, high)))
        hot = np.sort(rng.permutation(shared)[: rng.integers(len(shared) + 1)])
        cost = np.full(len(hot), 50.0)
        index = signatures(sets, np.array([low]), band, rule, hot, cost, True)
        own_band = rule.band(sets.n[[high]])[0] == band[0]
        probe = signatures(sets, np.array([high]), band, rule, hot, cost, bool(own_band))
        assert set(probe[0][probe[2]].tolist()) & set(index[0].tolist())


def set_pair(values):
    """Sets of given shingle hashes."""
    sets = Sets.__new__(Sets)
    sets.values = np.concatenate([np.sort(v) for v in values])
    sets.n = np.array([len(v) for v in values])
    sets.first = np.concatenate([[0], np.cumsum(sets.n)])
    return sets


@pytest.mark.parametrize("rule", [Rule(4, 85), Rule(5, 80), Rule(2, 50)])
def test_every_size_pair_meets(rule):
    """Sets as far apart as links allow meet, with one differing shingle in each of the segments looked up first."""
    rng, missed, band_of = np.random.default_rng(9), [], {n: int(rule.band(np.array([n]))[0]) for n in range(1, 200)}
    pool = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    for low in range(1, 61):
        band = np.array([band_of[low]])
        m = int(rule.segments(band)[0][0])
        segment = (mix(pool + jaccard_join._SALT) % np.uint64(m)).astype(int)
        for high in range(low, int(rule.largest_partner(np.array(low))) + 1):
            apart = int(rule.most_apart(np.array(low), np.array(high)))
            same = (low + high - apart) // 2
            assert apart < m and 100 * same >= rule.percent * (low + high - same)
            stack = {i: list(np.flatnonzero(segment == i)) for i in range(m)}
            differing = [stack[i].pop() for i in range(apart)]
            shared = [stack[i % m].pop() for i in range(same)]
            sets = set_pair([pool[shared + differing[: low - same]], pool[shared + differing[low - same :]]])
            index = signatures(sets, np.array([0]), band, rule, NONE, NONE, True)
            own = band_of[high] == band_of[low]
            probe = signatures(sets, np.array([1]), band, rule, NONE, NONE, own)
            met = set(probe[0][probe[2]].tolist()) & set(index[0].tolist())
            if own:
                met |= set(index[0][index[2]].tolist()) & set(probe[0].tolist())
            if not met:
                missed.append((low, high))
    assert not missed


def test_odd_rows(spark, odd_documents, no_documents):
    rows = jaccard_join.similar(odd_documents, Rule(4, 85)).collect()
    assert len(rows) == odd_documents.count()
    found = {r["doc_id"]: r for r in rows}
    assert found[1]["component_id"] == found[2]["component_id"] == 1
    assert found[7]["component_id"] == found[8]["component_id"] == 7
    assert [found[i]["n_shingles"] for i in (4, 5, 6, 13)] == [0, 0, 0, 1]
    assert [found[i]["component_id"] for i in (3, 4, 5, 6, 13)] == [3, 4, 5, 6, 13]
    assert sum(r["doc_id"] == 9 and r["component_id"] == 9 for r in rows) == 2
    assert jaccard_join.similar(no_documents, Rule()).count() == 0
