import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gleanmark.llm import spelling as P
from tests.llm.brute import LOWER

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def runs(text):
    return "".join(c if c in LETTERS else " " for c in (text or "").translate(LOWER)).split()


def plain(docs, least_length=6, least_count=5, factor=5, drop_in=199):
    counts = Counter()
    for doc_id, text in docs:
        for run in runs(text):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % drop_in == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    near = defaultdict(list)
    for a in counts:
        near[a] = [b for b in counts if abs(len(a) - len(b)) < 2 and one_apart(a, b)]
    form = {}
    for a, found in near.items():
        best = min(found, key=lambda b: (-counts[b], b.encode()), default=None)
        form[a] = best if best and counts[best] >= factor * counts[a] else None

    def root(w):
        return root(form[w]) if form.get(w) else w

    return sorted((w, n, len(near[w]), form[w], counts.get(form[w]), root(w)) for w, n in counts.items())


def shown(df):
    return sorted(tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


def misspelled(rng, word):
    at = rng.randrange(len(word))
    return rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice(LETTERS) + word[at + 1 :], word[:at] + rng.choice(LETTERS) + word[at:]])


@pytest.mark.parametrize("drop_in", [199, 3])
def test_against_all_pairs(spark, drop_in):
    rng = random.Random(drop_in)
    base = ["".join(rng.choices(LETTERS[:6] + "éÿ×", k=rng.randint(5, 11))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "abababab"]
    bag = base * 30
    for word in base:
        wrong = misspelled(rng, word)
        bag += [wrong] * rng.randint(1, 8) + [misspelled(rng, wrong)] * rng.randint(1, 6)
    rng.shuffle(bag)
    docs = [(None if i % 10 == 9 else i, " ".join(bag[i::70]).title() if i % 2 else "_".join(bag[i::70])) for i in range(70)]
    got = P.spelling_variants(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), drop_in=drop_in)
    assert shown(got) == plain(docs, drop_in=drop_in)


def test_chains_ties_and_long_words(spark):
    counts = {"abcdef": 5, "abcdefg": 25, "abcdefgh": 125, "xabcdefgh": 700, "zzzzzz": 5, "zzzzzy": 25, "zzzzzx": 25,
              "long" * 5000: 40, "long" * 5000 + "s": 6, "é" * 300: 5, "é" * 299: 25, "single": 9}
    vocab = spark.createDataFrame(list(counts.items()), "word string, n bigint").selectExpr("word", "n", "xxhash64(word) AS id")
    got = {r[0]: r[1:] for r in shown(P.grouped(vocab))}
    assert got["abcdef"] == (5, 1, "abcdefg", 25, "xabcdefgh")
    assert got["zzzzzz"] == (5, 2, "zzzzzx", 25, "zzzzzx")
    assert got["zzzzzy"] == (25, 2, None, None, "zzzzzy")
    assert got["long" * 5000 + "s"][2:] == ("long" * 5000, 40, "long" * 5000)
    assert got["é" * 300][3] == 25 and got["single"] == (9, 0, None, None, "single")


def test_neighbourhood_is_whole_and_without_repeats():
    rng = random.Random(2)
    power = P._powers(40)
    for _ in range(40):
        codes = [rng.randrange(3) for _ in range(rng.randint(1, 9))]
        around = {tuple(codes)}
        for i in range(len(codes) + 1):
            around |= {(*codes[:i], s, *codes[i:]) for s in range(3)}
        for i in range(len(codes)):
            around |= {(*codes[:i], s, *codes[i + 1 :]) for s in range(3)} | {(*codes[:i], *codes[i + 1 :])}
        keys = np.concatenate(list(P.neighbour_keys(np.array(codes, np.uint64), 3, power)))
        wanted = {int(P.own_key(np.array(w, np.uint64), power)[0]) for w in around}
        assert len(keys) == len(around) and set(keys.tolist()) == wanted


def test_batches_do_not_change_a_neighbourhood(monkeypatch):
    codes = np.array([1, 1, 2, 0, 2, 2, 1, 0, 0, 1] * 3, np.uint64)
    power = P._powers(64)
    whole = np.sort(np.concatenate(list(P.neighbour_keys(codes, 4, power))))
    monkeypatch.setattr(P, "BATCH_KEYS", 12)
    parts = list(P.neighbour_keys(codes, 4, power))
    assert len(parts) > 20 and np.array_equal(np.sort(np.concatenate(parts)), whole)


def test_odd_tables(spark, odd_documents, no_documents):
    docs = [(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()]
    assert shown(P.spelling_variants(odd_documents, least_count=2)) == plain(docs, least_count=2)
    assert P.spelling_variants(no_documents).count() == 0
