"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from themeflow.plans.oracles import ORACLES
from themeflow.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("documents", "events", "pages", "conversations")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_point.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    found = entry_point.queries()[name](spark, SF_DIR)
    columns = sorted(found.columns)
    rows = sorted((tuple(row[c] for c in columns) for row in found.collect()), key=repr)
    result = duck.execute(entry_point.oracle_sql()[name])
    names = [column[0] for column in result.description]
    assert sorted(names) == columns
    picks = [names.index(c) for c in columns]
    assert rows == sorted((tuple(row[i] for i in picks) for row in result.fetchall()), key=repr)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
