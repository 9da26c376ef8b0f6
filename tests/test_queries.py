import os

import pytest

import __spark_entry__ as entry
from inkstrata.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem documents conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return connection


def comparable(rows, columns):
    return sorted(repr([None if x is None or x != x else x for x in row]) for row in rows[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, wanted = entry.queries()[name](spark, DATA).toPandas(), duck.sql(SQL[name]).df()
    columns = sorted(wanted.columns)
    assert sorted(got.columns) == columns
    fix = lambda df: df.astype(object).where(df.notna(), None)
    assert comparable(fix(got), columns) == comparable(fix(wanted), columns)


def test_contract(spark):
    assert set(SQL) <= set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["doc_id", "ord", "level", "title"]
