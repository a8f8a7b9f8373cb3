"""Every registered query against its SQL, on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as job
from check_oracle import compare
from passagelake.fixtures import BASE_TABLES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    connection = duckdb.connect()
    for table in BASE_TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(job.queries()))
def test_matches_sql(spark, connection, name):
    plans = []

    def build(session, sf_dir):
        df = job.queries()[name](session, sf_dir)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    ok, note = compare(spark, connection, SF_DIR, name, build, job.oracle_sql().get(name))
    assert ok, note
    # nothing pairs all rows of two tables
    assert "CartesianProduct" not in plans[0] and "NestedLoopJoin" not in plans[0]


def test_every_sql_has_a_query():
    assert set(job.oracle_sql()) <= set(job.queries())


def test_entry_has_rows(spark):
    assert job.entry(spark).count() > 0
