import math
import random
import re
from collections import Counter

import pytest

from gleanmark.llm import lexical_search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return Counter(TERM.findall(lower))


def plain(docs, items, k=10):
    """Scores of all documents, by the formula."""
    held = [(i, terms(t)) for i, t in docs if terms(t)]
    n_docs, total = len(held), sum(c.total() for _i, c in held)
    df = Counter(t for _i, c in held for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for i, c in held:
            m = 25 + 75 * c.total() * n_docs // total
            s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                    for t, r in terms(text).items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def found(docs, items, **options):
    return [tuple(r) for r in S.search(docs, items, **options).collect()]


@pytest.fixture
def small_blocks(monkeypatch):
    """Many blocks in a task, so that later ones start from the scores of earlier ones."""
    monkeypatch.setattr(S, "BLOCK_DOCUMENTS", 20)


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3], str(r[2])))


def test_against_all_scores(spark, small_blocks):
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)] + ["Über", "漢字", "x1"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    docs = [(i, text(rng.randint(1, 60))) for i in range(900)]
    docs += [(2000 + i, docs[i % 7][1]) for i in range(40)]        # ties
    docs += [(5, docs[5][1]), (None, docs[5][1]), (7000, None), (7001, ""), (7002, "-- !!")]
    items = [(i, text(rng.randint(1, 25))) for i in range(30)]
    items += [(3, docs[5][1]), (items[0]), (90, None), (91, "??"), (92, "nowhere else"), (None, text(4)), (93, "w1 w1 w1")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id bigint, text string")
    wanted = order(plain(docs, items))
    assert order(found(d, q)) == wanted
    assert order(found(d, q, k=3)) == order(plain(docs, items, 3))


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_TERMS", 5)
    docs = [(i, f"a{i % 5} b{i % 7} c{i % 3}") for i in range(60)]
    items = [(i, f"a{i} b{i} c{i}") for i in range(7)]
    monkeypatch.setattr(S.numbered_items, "__defaults__", (5,))
    got = found(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert order(got) == order(plain(docs, items))


def test_pruning_does_less(spark, some_documents):
    """Accumulators stop before the frequent terms: the block's scores are made from fewer postings than there are."""
    import numpy as np

    rng = np.random.default_rng(1)
    n = 2000
    rare = np.arange(12)
    owner = np.concatenate([rare, np.arange(n)])
    terms_ = np.concatenate([np.zeros(12, np.int64), np.ones(n, np.int64)])
    order_ = np.lexsort((terms_, owner))
    sizes = np.bincount(owner, minlength=n)
    block = S._Block(np.arange(n), rng.integers(20, 60, n), sizes, terms_[order_], np.ones(len(owner), np.int64), n, 40 * n)
    ids, scores = block.best(np.array([0, 1]), np.array([5000, 10]), 10, 1)
    assert len(ids) <= 12 and set(ids) <= set(range(12)) and not block.scores.any()
    assert (scores > 5000 * block.gain.min()).all()


def test_odd_tables(spark, odd_documents, no_documents):
    items = [(1, "quick brown fox"), (2, "漢字 same row"), (3, "id")]
    q = spark.createDataFrame([(*r, "w", 1.0, 2) for r in items], "item_id bigint, text string, word string, score double, rank int")
    docs = [(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()]
    assert order(found(odd_documents, q)) == order(plain(docs, items))
    assert found(no_documents, q) == []
    assert found(odd_documents, q.where("false")) == []
