"""Every query with SQL against that SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _norm(v):
    return repr(round(v, 9)) if isinstance(v, float) else repr(v)


KV = sorted(k for k in entry.queries() if k.startswith("kv_"))


@pytest.mark.parametrize("name", KV)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = duck.sql(sql)
    names = sorted(df.columns)
    assert sorted(found.columns) == names
    at = [found.columns.index(c) for c in names]
    assert sorted(tuple(_norm(r[c]) for c in names) for r in rows) == sorted(tuple(_norm(r[k]) for k in at) for r in found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["key", "seq", "value"]
