"""Every query of the library proper against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from tessera.plans import relational_queries, scalar_queries

DATA = "/root/testdata/sf0.001"
QUERIES = relational_queries.QUERIES | scalar_queries.QUERIES
SQL = relational_queries.SQL | scalar_queries.SQL


def rows(pdf):
    own = pdf[sorted(pdf.columns)]
    return sorted(map(str, own.astype(object).where(own.notna(), None).values.tolist()))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(SQL) <= set(__spark_entry__.oracle_sql())
