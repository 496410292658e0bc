"""Every registered query against its SQL on the given tables."""

import os

import pytest

import __spark_entry__ as entry
from checks import registered
from checks.compare import compare, connect

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def db():
    return connect(DATA)


def test_entry_points(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registered()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(registered()))
def test_query(spark, db, name):
    query, sql = registered()[name]
    assert sql is not None
    assert compare(spark, db, DATA, query, sql) == []
