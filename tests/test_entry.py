"""Registered queries against their DuckDB text, as the driver compares them."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return str(value)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    result = entry.queries()[name](spark, FOLDER)
    rows = result.collect()
    columns = sorted(result.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in rows)
    if name not in entry.oracle_sql():
        assert rows
        return
    oracle = duck.sql(entry.oracle_sql()[name])
    assert sorted(oracle.columns) == columns
    want = sorted(tuple(plain(dict(zip(oracle.columns, r))[c]) for c in columns) for r in oracle.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_name_known_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
