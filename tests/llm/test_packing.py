import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from gleanmark.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def packed(docs, **options):
    return P.pack(docs, PATH, public_tokenizers.PATTERN, **options).collect()


def check_whole(rows, docs, library, window=1024):
    """Every id in one piece, sequences without gaps, whole windows or powers of two."""
    wanted = sorted((str(i), [*library.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in docs)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        pieces[str(r.doc_id), r.doc_tokens].append((r.start, ids))
        sequences[r.sequence_id].append((r.offset, r.length))
    got = []
    for (doc, tokens), parts in pieces.items():
        parts.sort(key=lambda p: p[0])
        copies = sum(1 for start, _ids in parts if start == 0)
        if copies == 1:
            assert [s for s, _ in parts] == [sum(len(i) for _, i in parts[:k]) for k in range(len(parts))]
            got.append((doc, [x for _, ids in parts for x in ids]))
        else:                                       # repeated rows, all uncut in these tests
            got += [(doc, ids) for _, ids in parts]
        assert sum(len(i) for _, i in parts) == copies * tokens
    assert sorted(got) == wanted
    sizes = []
    for spans in sequences.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))]
        sizes.append(sum(n for _, n in spans))
    assert all(s == window or s < window and s & (s - 1) == 0 for s in sizes)
    assert sum(s < window for s in sizes) <= window.bit_length()


def mixed(n, seed):
    rng = random.Random(seed)
    words = "the quick brown fox jumps over lazy dogs Zürich 12345 ... <|endoftext|> 漢字".split()
    source = lambda: rng.choices(["big", "mid", None, "tiny"], [60, 30, 9, 1])[0]
    return [(i, source(), " ".join(rng.choices(words, k=int(rng.paretovariate(0.6))))[:30000]) for i in range(n)]


@pytest.mark.parametrize("group", [4, 256])
def test_whole_and_mixed(spark, library, group):
    docs = mixed(700, group)
    frame = spark.createDataFrame(docs, "doc_id bigint, source string, text string").repartition(4)
    rows = packed(frame, group=group)
    check_whole(rows, [(d[0], d[2]) for d in docs], library)
    total = sum(r.length for r in rows)
    share = defaultdict(int)
    for r in rows:
        share[r.source] += r.length
    served = defaultdict(int)
    by_sequence = defaultdict(lambda: defaultdict(int))
    for r in rows:
        by_sequence[r.sequence_id][r.source] += r.length
    done = 0
    for sequence in sorted(by_sequence):
        for s, n in by_sequence[sequence].items():
            served[s] += n
            done += n
        assert all(abs(served[s] - done * share[s] / total) <= 2 * P.LEAST for s in share), sequence


def test_weights_hold_until_a_source_ends(spark):
    docs = [(i, s, "word " * n) for s, n, k in (("a", 200, 40), ("b", 300, 40), ("c", 500, 40)) for i in range(k)]
    frame = spark.createDataFrame(docs, "doc_id bigint, source string, text string").repartition(3)
    rows = packed(frame, weights={"a": 2, "b": 1, "c": 1}, window=256, group=8)
    lengths = defaultdict(lambda: defaultdict(int))
    for r in rows:
        lengths[r.sequence_id][r.source] += r.length
    total_a = sum(r.length for r in rows if r.source == "a")
    early = [lengths[s] for s in sorted(lengths) if (s + 1) * 128 < total_a]
    assert len(early) > 20
    assert all(abs(sum(w[s] for w in early) - len(early) * 256 * p) <= 2 * P.LEAST for s, p in (("a", 0.5), ("b", 0.25), ("c", 0.25)))
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)


def test_shares_are_the_first_tokens_by_virtual_time():
    rng = random.Random(3)
    for _ in range(60):
        totals = [rng.choice([0, 1, 2, 7, 30]) for _ in range(rng.randint(1, 6))]
        weights = rng.choice([None, [rng.randint(1, 9) for _ in totals]])
        shares = P.Shares(totals, weights)
        order = sorted((Fraction(2 * j + 1, 2 * w), q) for q, (n, w) in enumerate(zip(totals, shares.weights, strict=True)) for j in range(n))
        for x in range(sum(totals) + 1):
            assert list(shares.at(x)) == [sum(1 for _t, q in order[:x] if q == k) for k in range(len(totals))]
            assert abs(float(shares.goals(np.array([x]), np.arange(len(totals))).sum()) - x) < 1e-6


def test_many_sources_share_queues(spark, library):
    docs = [(i, f"s{i % 40}", f"text number {i} " * (i % 9)) for i in range(200)]
    frame = spark.createDataFrame(docs, "doc_id bigint, source string, text string").repartition(3)
    rows, named = P.queued(P.encoded(frame, PATH, public_tokenizers.PATTERN), queues=5)
    assert {r.queue for r in named.collect()} == {0, 1, 2, 3, 4} and named.count() == 40
    taken = defaultdict(list)
    for r in rows.select("queue", "start", "n").collect():
        taken[r.queue].append((r.start, r.n))
    for spans in taken.values():
        spans.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and spans[0][0] == 0


def test_same_ids_as_the_library(library):
    from gleanmark.llm import bpe

    coder = P.encoder(bpe.read_spec(PATH), public_tokenizers.PATTERN)
    rng = random.Random(5)
    letters = "aB9 \n\t'sé漢😀…" + "".join(map(chr, (0x558, 0x85, 0xA0, 0x2003, 0x0301, 0x200D)))
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(3000)] + ["a<|endoftext|> b", "<|endoftext|>" * 2, "x" * 50000]
    assert [coder.encode(t).tolist() for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_odd_tables(spark, odd_documents, no_documents, library):
    docs = [(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()]
    rows = packed(odd_documents)
    single = [d for d in docs if d[0] in (7, 8, 1)]
    for doc_id, text in single:
        parts = sorted((r.start, r.ids) for r in rows if r.doc_id == doc_id)
        ids = np.frombuffer(b"".join(p[1] for p in parts), "<u4").tolist()
        assert ids == [*library.encode(text, add_special_tokens=False).ids, 0]
    assert sum(r.length for r in rows) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _i, t in docs)
    assert packed(no_documents) == []
