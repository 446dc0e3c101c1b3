import hashlib
import re

from pyspark.sql import functions as F

from gleanmark.llm import fingerprints as P


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}


def likeness(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_against_brute_force(some_documents, odd_documents):
    for docs in (some_documents, odd_documents):
        given = sorted(((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()),
                       key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        expected = []
        for i, (doc_id, text) in enumerate(given):
            following = given[(i + 1) % len(given)][1]
            half = len(text) // 2
            edited = text[: len(text) - half] + following[:half]
            expected.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), likeness(text, edited), likeness(text, following)))
        found = P.fingerprinted(docs).collect()
        assert len(found) == len(expected)
        key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
        rows = sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in found), key=key)
        for f, e in zip(rows, sorted(expected, key=key), strict=True):
            assert f[:3] == e[:3]
            assert abs(f[3] - e[3]) < 0.12 and abs(f[4] - e[4]) < 0.12


def test_sketches(spark):
    a, b = " ".join(f"w{i}" for i in range(4000)), " ".join(f"w{i}" for i in range(2000, 5000))
    docs = spark.createDataFrame([(a, b, a + " " + b)], "a string, b string, ab string")
    for c in ("a", "b"):
        docs, _name = P.with_sketch(docs, c, f"{c}_sketch")
    (r,) = docs.select(P.resemblance(F.col("a_sketch"), F.col("b_sketch")).alias("r"), P.n_distinct(F.col("a_sketch")).alias("n"),
                       P.containment(F.col("b_sketch"), F.col("a_sketch")).alias("c"),
                       P.n_distinct(P.merge(F.col("a_sketch"), F.col("b_sketch"))).alias("both")).collect()
    assert abs(r["r"] - 1996 / 4996) < 0.1 and abs(r["n"] / 3996 - 1) < 0.2
    assert abs(r["c"] - 1996 / 2996) < 0.15 and abs(r["both"] / 4996 - 1) < 0.2


def test_parts_merge(spark):
    text = " ".join(f"w{i * i % 977}" for i in range(900))
    words = text.split()
    docs = spark.createDataFrame([(text, " ".join(words[:500]), " ".join(words[496:]))], "a string, b string, c string")
    for c in ("a", "b", "c"):
        docs, _name = P.with_sketch(docs, c, f"{c}_sketch")
    (r,) = docs.select("a_sketch", P.merge(F.col("b_sketch"), F.col("c_sketch")).alias("m")).collect()
    assert r["a_sketch"] == r["m"]


def test_uneven_ids(spark):
    rows = [(i * i * i, f"text number {i} of the table") for i in range(1500)] + [(1 << 60, "far away"), (-5, "below")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    following = {r["doc_id"]: r["next_text"] for r in P.with_next(docs).collect()}
    given = sorted(rows)
    assert following == {r[0]: given[(i + 1) % len(given)][1] for i, r in enumerate(given)}


def test_native_and_empty(spark, no_documents, odd_documents, capsys):
    assert P.fingerprinted(no_documents).count() == 0
    one = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    assert P.fingerprinted(one).first()["near_next"] == 1.0
    P.fingerprinted(odd_documents).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)
