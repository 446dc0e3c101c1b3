"""The registered queries: contract columns, and their SQL where there is some."""
import duckdb
import pytest

from gleanmark.llm import catalog

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_quality_classifier": "doc_id held_out score predicted",
    "op2_html_extraction": "page_id url text n_chars",
    "op3_bpe_coding": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op4_jaccard_join": "doc_id n_shingles component_id",
    "op5_line_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op6_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op7_source_mix": "doc_id size source_size target taken first_slot n_slots",
    "op8_line_dedup": "doc_id n_chars text_sha256",
    "op9_language_id": "doc_id held_out lang_pred score",
    "op10_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op11_lexical_search": "item_id rank doc_id score",
    "op12_mixture_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op13_spelling_variants": "word form root n n_near form_n",
}
#: Queries with a row for every row of a table; of the others, the numbers of rows follow from their SQL or own tests.
PER_ROW = {name: "pages" if name.startswith("op2") else "documents" for name in sorted(COLUMNS) if int(name[2:].split("_")[0]) <= 10}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "labels", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows_of(frame):
    frame = frame.reindex(sorted(frame.columns), axis=1)
    values = frame.astype(object).where(frame.notna(), None)

    def shown(value):
        return str(float(value)) if isinstance(value, int | float) and not isinstance(value, bool) else str(value)

    return list(frame.columns), sorted(tuple(map(shown, row)) for row in values.itertuples(index=False))


def test_names():
    assert set(catalog.queries()) == set(COLUMNS)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, duck, name):
    out = catalog.queries()[name](spark, SF)
    assert set(COLUMNS[name].split()) <= set(out.columns)
    got = out.toPandas()
    assert len(got) > 0
    if name in PER_ROW:
        assert len(got) == duck.execute(f"SELECT count(*) FROM {PER_ROW[name]}").fetchone()[0]
    if name in catalog.oracle_sql():
        assert rows_of(got) == rows_of(duck.execute(catalog.oracle_sql()[name]).df())
