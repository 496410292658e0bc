import pytest


@pytest.fixture
def frame(spark):
    """A frame from tuples and a DDL schema; empty ones too."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
