"""The text queries that have SQL against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tracemill.llm import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no tables")
@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query(spark, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    df = queries.queries()[name](spark, SF_DIR)
    found = c.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(r[x] for x in columns) for r in df.collect()) == sorted(found.fetchall())
