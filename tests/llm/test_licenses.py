import re

from gleanmark.llm import licenses

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def test_base_phrases(spark, odd_documents, some_documents):
    odd = spark.createDataFrame(
        [(1, "MIT License, mit-license; the Apache\nLicense. mit"), (2, "GENERAL public/License general public"), (3, "mit licenseé"), (4, "mit license " * 50)],
        "doc_id long, text string")
    for docs in (odd_documents, some_documents, odd):
        rows = licenses.scan(docs).collect()
        given = docs.select("doc_id", "text").collect()
        assert len(rows) == len(given)
        expected = []
        for r in given:
            w, hits = words(r["text"]), []
            for label, phrase in licenses.BASE_PHRASES:
                p = phrase.split()
                hits += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
            at = [i for i, _ in hits]
            expected.append((r["doc_id"], len(w), len(hits), min(at, default=None), max(at, default=None),
                             ",".join(sorted({label for _, label in hits}))))
        found = [(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows]
        assert sorted(found, key=str) == sorted(expected, key=str)
        assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in rows)


def test_texts_with_changes(spark):
    text = dict(licenses.TEXTS[::-1])["mit"].split()
    changed = text[:10] + ["extra", "words"] + text[10:25] + text[26:]
    docs = spark.createDataFrame(
        [(1, " ".join(text).upper()), (2, "before " * 5 + ", ".join(changed) + " after"), (3, " ".join(text[:12])), (4, "unrelated")],
        "doc_id long, text string")
    found = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert found[1]["labels"] == found[2]["labels"] == "mit"
    assert found[1]["score"] == 1.0 and 0.5 <= found[2]["score"] < 1.0
    assert found[3]["labels"] == found[4]["labels"] == "" and found[4]["score"] == 0.0
    spans = licenses.spans(docs).where("label = 'mit' and doc_id = 2").collect()
    assert [(s["first_word"], s["last_word"]) for s in spans] == [(5, 5 + len(changed) - 1)]


def test_native_and_empty(no_documents, odd_documents, capsys):
    assert licenses.scan(no_documents).count() == 0
    licenses.scan(odd_documents).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)
