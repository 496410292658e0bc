"""Connected components of a table of links, by shuffles only.

Defined results: links with a NULL end, and from a node to itself, link nothing; repeated
links count once; no links, no components. The smallest node stands for a component, so there
are no ties. All links of a component's smallest node meet it in one join, which Spark splits
where it is skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicegate.llm.tables import Staging

MAX_ROUNDS = 60


def components(links: DataFrame, staging: Staging) -> DataFrame:
    """node, component: the smallest node that links (a, b) reach, for every node in a link
    to another. Alternates two steps until nothing changes: each node sends its larger
    neighbours to the smallest one it sees, then its smaller ones. The number of rounds
    grows with the logarithm of the longest path. Starts jobs."""
    now = staging.keep(_directed(links), "links")
    before = None
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        larger = _to_smallest(both).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
        smaller = _to_smallest(_directed(larger))
        moved = smaller.select(F.col("b").alias("a"), F.col("least").alias("b"))
        own = smaller.select("a", F.col("least").alias("b"))
        last, now = now, staging.keep(_directed(moved.unionByName(own)), "links")
        staging.drop(last)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = seen
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def _directed(links: DataFrame) -> DataFrame:
    """Every link once, from the larger to the smaller node."""
    return (
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    )


def _to_smallest(links: DataFrame) -> DataFrame:
    """Links a, b with `least`, the smallest of a and all its neighbours here."""
    least = links.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
    return links.join(least, "a")
