"""Every registered query against its SQL twin on the same tables."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_points
from playlog.plans.oracle import ORACLE
from playlog.plans.registry import QUERIES

DEFAULT = "/root/testdata/sf0.01"
SF_DIR = os.environ.get("TEST_SF_DIR", DEFAULT)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("events", "lineitem"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    yield connection
    connection.close()


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(ORACLE) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    ours = QUERIES[name](spark, SF_DIR)
    twin = duck.execute(ORACLE[name])
    columns = [column[0] for column in twin.description]
    assert sorted(ours.columns) == sorted(columns)
    expected = Counter(twin.fetchall())
    assert Counter(tuple(row) for row in ours.select(columns).collect()) == expected
    # The smallest tables lack the customer of the extraction queries.
    assert expected or SF_DIR != DEFAULT


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
