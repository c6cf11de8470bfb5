"""Every query that has SQL against DuckDB on the smallest tables, and the rest for a result."""

import math
import os
from decimal import Decimal
from pathlib import Path
from urllib.parse import quote

import duckdb
import pytest

import __spark_entry__ as entry_module

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no tables")
NAMES = list(entry_module.catalog.QUERIES)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF_DIR).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    return v if v is None or isinstance(v, (bool, int)) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry_module.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in entry_module.oracle_sql():
        assert rows
        return
    found = duck.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert rows == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())


def test_every_url_is_encoded(spark, duck, tmp_path):
    urls = ["https://a.b/c?d=e&f=g#h", "a b+c%20%2f", "~!'()*-_.", "/日本/é\U0001f600", "", "\"<>[]{}|\\^`\n;,@$", None]
    rows = [(k, u, "") for k, u in enumerate(urls)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    # What encodeURIComponent leaves as it is.
    wanted = [(k, u, None if u is None else quote(u, safe="-_.!~*'()")) for k, u, _ in rows]
    assert sorted(tuple(r) for r in entry_module.queries()["path_encode_all"](spark, str(tmp_path)).collect()) == wanted
    sql = entry_module.oracle_sql()["path_encode_all"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(duck.execute(sql).fetchall()) == wanted
    assert entry_module.queries()["path_encode_all"](spark, SF_DIR).count() == duck.execute("SELECT count(*) FROM pages").fetchone()[0]


def test_entry(spark):
    assert entry_module.entry(spark).limit(1).count() == 1
