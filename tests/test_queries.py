"""Every query with SQL gives the rows that DuckDB gives; the others give rows."""

import numbers
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.queries() if n != "pipeline" and not n.startswith("op")]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def text(x):
        if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
            return "none"
        if isinstance(x, numbers.Number) and not isinstance(x, bool):  # a column of integers with nulls becomes floats in pandas
            return repr(float(x))
        return str(list(x)) if hasattr(x, "__len__") and not isinstance(x, str) else str(x)

    return sorted(tuple(text(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 25
