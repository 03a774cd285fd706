"""Every registered query against its SQL statement in a second engine."""

import duckdb
import pytest

import __spark_entry__ as registered
from shopmeter.registry.oracle import ORACLES as STATEMENTS
from shopmeter.registry.spark_queries import QUERIES
from shopmeter.registry.views import TABLES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(STATEMENTS)
    assert set(QUERIES) <= set(registered.queries())
    assert set(STATEMENTS) <= set(registered.oracle_sql())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_equals_its_statement(spark, engine, key):
    df = QUERIES[key](spark, SF_DIR)
    names = sorted(df.columns)
    mine = sorted((tuple(row[n] for n in names) for row in df.collect()), key=repr)
    cursor = engine.execute(STATEMENTS[key])
    theirs_names = [d[0] for d in cursor.description]
    assert sorted(theirs_names) == names
    order = [theirs_names.index(n) for n in names]
    theirs = sorted((tuple(row[i] for i in order) for row in cursor.fetchall()), key=repr)
    assert mine == theirs
    plan = df._jdf.queryExecution().executedPlan().toString()
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python"):
        assert banned not in plan


def test_entry(spark):
    df = registered.entry(spark)
    assert len(df.columns) == 24 and not df.isEmpty()
