"""Every query with SQL gives the same rows in Spark and in DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__
from crestline.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    return f"{float(value):.9g}" if isinstance(value, int | float) else str(value)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query(spark, duck, sf_dir, name):
    got = plans.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = duck.sql(plans.ORACLES[name])
    assert sorted(want.columns) == columns
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    assert rows


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(plans.QUERIES) <= set(__spark_entry__.queries())
    assert set(plans.ORACLES) <= set(__spark_entry__.oracle_sql())
