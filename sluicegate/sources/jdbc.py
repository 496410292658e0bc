"""JDBC query scan."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def jdbc_options(
    query: str,
    options: Mapping[str, str],
    partition_column: str | None = None,
    lower: int | str | None = None,
    upper: int | str | None = None,
    partitions: int | None = None,
) -> dict[str, str]:
    """Reader options for a query as derived table; parallel when a partition column,
    its bounds and a partition count are given (bounds set the stride, no row is lost)."""
    if "dbtable" in options or "query" in options:
        raise ValueError("the query is an argument of its own")
    chosen = {**options, "dbtable": f"({query.strip().rstrip(';')}) t"}
    split = {
        "partitionColumn": partition_column,
        "lowerBound": lower,
        "upperBound": upper,
        "numPartitions": partitions,
    }
    given = {k: str(v) for k, v in split.items() if v is not None}
    if given and len(given) < len(split):
        raise ValueError(f"a partitioned read needs all of {sorted(split)}")
    return {**chosen, **given}


def read_jdbc(spark: SparkSession, query: str, options: Mapping[str, str], **partitioning) -> DataFrame:
    """Run a query in the database and read its result. Filters and column selections
    on the returned frame are pushed into the database."""
    return spark.read.format("jdbc").options(**jdbc_options(query, options, **partitioning)).load()
