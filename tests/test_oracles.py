"""Every registered query with SQL against DuckDB, on the smallest tables; the others must give rows of a stable schema."""

import decimal

import duckdb
import pytest

from plumbline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, str):
        return v or ""
    if isinstance(v, float):
        return "nan" if v != v else format(round(v, 8), ".11g")
    return format(v, "f") if isinstance(v, decimal.Decimal) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    want = duck.sql(sql)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry_stands_alone():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "cmp_keyed_diff" in e.queries()
