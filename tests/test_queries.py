"""Every registered query against its SQL, over whole tables."""

import os

import duckdb
import pytest

from lwwspark.oracle import ORACLE_SQL
from lwwspark.queries import QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return db


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    expected = duck.sql(ORACLE_SQL[name])
    assert sorted(expected.columns) == columns
    order = [expected.columns.index(c) for c in columns]
    key = lambda row: tuple(map(repr, row))
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=key) == sorted((tuple(plain(r[i]) for i in order) for r in expected.fetchall()), key=key)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries()) and set(ORACLE_SQL) <= set(e.oracle_sql()) <= set(e.queries())
