"""The registered queries against their SQL, or at least whole, on the given tables."""

import os

import pytest

from checks.compare import compare, connect
from sluicegate.llm.queries import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def db():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, db, name):
    assert compare(spark, db, DATA, QUERIES[name], ORACLES[name]) == []
