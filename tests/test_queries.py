"""Every registered query against its SQL in DuckDB on the smallest tables."""
import os

import duckdb
import pytest

from gleanmark import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


def rows_of(frame):
    frame = frame.reindex(sorted(frame.columns), axis=1)
    values = frame.astype(object).where(frame.notna(), None)
    return list(frame.columns), sorted(tuple(map(str, row)) for row in values.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
    else:
        assert rows_of(got) == rows_of(duck.execute(sql).df())
