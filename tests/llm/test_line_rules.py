import re
from collections import Counter

from gleanmark.llm import line_rules


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    cover = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def test_counts(spark, odd_documents, some_documents):
    repeats = spark.createDataFrame([(1, "a\n\na\n b\x0bc\x0c\n"), (2, "é é\té\n" * 30), (3, "x " * 7 + "\n" + "x " * 9)],
                                    "doc_id long, text string").selectExpr("doc_id", "text", "'s' AS source")
    for docs in (odd_documents, some_documents, repeats):
        rows = line_rules.quality_rules(docs).collect()
        assert len(rows) == docs.count()
        found = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows)
        assert found == Counter((r["doc_id"], *counts(r["text"])) for r in docs.select("doc_id", "text").collect())
        for r in rows:
            failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
            assert r["base_failed"] == failed and not (failed and r["kept"])


def test_frequent_lines_and_depleted_documents(spark):
    notice = "Subscribe  NOW to our daily newsletter and never miss a story again"
    rows = [(i, f"{notice.upper() if i % 2 else notice}\n" + " ".join(f"w{i}x{j}" for j in range(60)), "a") for i in range(40)]
    rows += [(100, f"{notice}\n{notice}\n{notice}\nshort rest of the page", "a"), (101, f"{notice} \n" + " ".join(f"v{j}" for j in range(30)), "b")]
    rows += [(200 + i, "an article that was copied many times over\n" + " ".join(f"c{j}" for j in range(40)), "a") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r["doc_id"]: r for r in line_rules.quality_rules(docs).collect()}
    assert all(found[i]["n_boilerplate_words"] == 12 and found[i]["kept"] for i in range(40))
    assert found[100]["n_boilerplate_words"] == 36 and not found[100]["kept"] and not found[100]["base_failed"] or found[100]["base_failed"]
    assert found[101]["n_boilerplate_words"] == 0
    assert all(found[200 + i]["kept"] for i in range(50))       # copies count as one document


def test_empty_table(no_documents):
    assert line_rules.quality_rules(no_documents).count() == 0
