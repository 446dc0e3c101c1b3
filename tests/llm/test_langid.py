import hashlib
import zlib

import numpy as np

from gleanmark.llm import langid


def brute_force(emitted, transitions):
    n, k = emitted.shape
    forward, back, v = np.zeros((n, k)), np.zeros((n, k)), np.zeros(k)
    for t in range(n):
        v = np.logaddexp.reduce(v[:, None] + transitions, axis=0) + emitted[t]
        forward[t] = v
    for t in range(n - 2, -1, -1):
        back[t] = np.logaddexp.reduce(transitions + (back[t + 1] + emitted[t + 1])[None, :], axis=1)
    total = forward + back
    return np.exp(total - np.logaddexp.reduce(total, axis=1)[:, None])


def test_marginals():
    rng = np.random.default_rng(0)
    emitted, transitions = rng.normal(size=(1500, 3)) * 2, rng.normal(size=(3, 3))
    first = np.array([0, 0, 5, 700, 700, 1500])
    found = langid.marginals(emitted.astype(np.float32), transitions.astype(np.float32), first)
    for a, b in ((0, 5), (5, 700), (700, 1500)):
        assert np.abs(found[a:b] - brute_force(emitted[a:b], transitions)).max() < 1e-4


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(*langid.labelled_sample(docs))
    rows = langid.identified(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_code_switching(spark, some_documents):
    texts = {r["lang"]: r["text"] for r in some_documents.where("length(text) between 800 and 3000").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(*langid.labelled_sample(docs))
    cut = {lang: " ".join(text.split()[:80]) for lang, text in texts.items()}
    mixed = spark.createDataFrame([(f"{cut['en']} {cut['fr']} {cut['de']}",)], "text string")
    (row,) = mixed.select(langid.label_words(model)("text").alias("runs")).collect()
    share = {lang: sum(r["n_words"] for r in row["runs"] if r["lang"] == lang) for lang in ("en", "fr", "de")}
    assert all(n > 50 for n in share.values())


def test_odd_rows(spark, odd_documents, no_documents):
    model = langid.train(["the cat and the dog", "le chat et le chien"] * 5, ["en", "fr"] * 5)
    rows = langid.identified(odd_documents, model).collect()
    assert len(rows) == odd_documents.count()
    by_id = {r["doc_id"]: r["lang_pred"] for r in rows if r["doc_id"] is not None}
    assert all(by_id[i] == "und" for i in (4, 5, 6, 11))
    assert by_id[12] in ("en", "fr")
    assert langid.identified(no_documents, model).count() == 0
    assert langid.labelled_sample(no_documents) == ([], [])
    nothing = langid.train([], [])
    assert {r["lang_pred"] for r in langid.identified(odd_documents, nothing).collect()} == {"und"}


def test_sample_skips_long_texts_and_has_all_languages(spark):
    ids = sorted((i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1), key=lambda i: hashlib.md5(str(i).encode()).digest())
    rows = [(i, f"text {i} of the usual length", "en") for i in ids]
    rows[0] = (ids[0], "long " * 1000, "en")
    rows[-1] = (ids[-1], "un texte rare", "fr")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    texts, langs = langid.labelled_sample(docs, rows=20, sample_bytes=2000)
    assert len(texts) == 20 and set(langs) == {"en", "fr"}
    assert "un texte rare" in texts and not any(t.startswith("long") for t in texts)
    texts, _ = langid.labelled_sample(docs, rows=200, sample_bytes=2000)
    assert 1900 < sum(len(t) for t in texts) <= 2000
