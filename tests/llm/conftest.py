import pytest

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
          "score double, n bigint, node bigint, key string, size bigint, words string, taken int, sketch string, "
          "root bigint, component_id bigint, line_no int, bucket int, ids string, kept boolean, quality_score double, "
          "k bigint, best boolean, doc_key bigint, `group` bigint, a string, b string, item bigint, queue int, start bigint")
CLASHING = (0.5, 7, 8, "k", 9, "w", 1, "s", 2, 3, 4, 5, "i", False, 0.1,
            11, True, 12, 13, "a", "b", 14, 15, 16)


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Documents with nulls in every column, empty and long texts, ties, repeated rows and clashing further columns."""
    base = "the quick brown fox jumps over the lazy dog while a cold wind blows across the quiet old harbour town tonight"
    long = "\n".join(f"{base} {i} {i * 7919 % 1013} and more words follow here" for i in range(3000))
    rows = [
        (1, base, "en", "a", 100), (2, base, "en", "a", 100), (3, base.replace("cold", "warm"), "en", "b", 100),
        (4, None, "en", "a", 0), (5, "", "de", None, 0), (6, "  \n\t \n", None, "b", 5), (None, "text without an id", "en", "b", 1),
        (None, None, None, None, None), (7, long, "en", "a", None), (8, long + " end", "en", "a", None),
        (9, "same row twice in the table", "en", "c", 3), (9, "same row twice in the table", "en", "c", 3),
        (10, "same id, other text", "en", "c", 3), (10, "same id, yet another text", "en", "c", 3),
        (11, "1234 5678 %% !!", "en", "c", 3), (12, "ünïcode … Ωmega 漢字 😀", None, "é", 3), (13, "a", "fr", "é", 1),
    ]
    return spark.createDataFrame([(*r, *CLASHING) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def some_documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
