"""Lineages of template versions: chains of parents of any length, by pointer doubling."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicegate.plans.skew import lookup_join
from sluicegate.sources.workspace import materialise, new_folder, remove_folder


def lineages(templates: DataFrame, parent: str = "parent_template_id") -> DataFrame:
    """(id, root_id, steps, in_cycle) for every template with an id.

    `root_id` is the end of the chain of parents, itself for a template without one, and
    the missing id where a parent is not in the table; `steps` are the versions between.
    Templates on a cycle, or above which there is one, have no root. Every round lets a
    template point to where its ancestor points, so a chain of length n takes log2(n) rounds
    of one join; templates that have arrived are not joined again, and a parent of very many
    versions is spread (`lookup_join`). Both sides grow with the templates, so no side is
    broadcast by a hint, which would send it through the driver in every round. Starts jobs.
    """
    spark = templates.sparkSession
    folder = new_folder(spark, "lineages")
    own = templates.filter(F.col("id").isNotNull()).select("id", F.col(parent).alias("up"))
    parents = materialise(own.filter(F.col("up").isNotNull()), "parents", folder)
    # `at`: an ancestor, `steps` above; open while that one has a parent, too.
    arrived = own.filter(F.col("up").isNull()).select("id", F.col("id").alias("at"), F.lit(0).cast("bigint").alias("steps"))
    hops = materialise(parents.select("id", F.col("up").alias("at"), F.lit(1).cast("bigint").alias("steps")), "hops_0", folder)
    done = [arrived]
    for turn in range(1, 2 + math.ceil(math.log2(max(2, hops.count())))):
        onward = hops.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("steps").alias("more")).hint("merge")
        joined = materialise(lookup_join(_open(hops, done, turn), onward, ["at"], "id"), f"joined_{turn}", folder)
        done.append(joined.filter(F.col("next").isNull()).select("id", "at", "steps"))
        ahead = joined.filter(F.col("next").isNotNull()).select("id", F.col("next").alias("at"), (F.col("steps") + F.col("more")).alias("steps"))
        if ahead.isEmpty():
            hops = ahead
            break
        # What has arrived still shows others the way.
        hops = materialise(ahead.unionByName(_settled(done)), f"hops_{turn}", folder)
    found = _union(done).select("id", F.col("at").alias("root_id"), "steps", F.lit(False).alias("in_cycle"))
    lost = own.join(found.select("id").hint("merge"), "id", "left_anti").select(
        "id", F.lit(None).cast(own.schema["id"].dataType).alias("root_id"), F.lit(None).cast("bigint").alias("steps"), F.lit(True).alias("in_cycle")
    )
    result = materialise(found.unionByName(lost), "lineage")
    remove_folder(spark, folder)
    return result


def _union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for more in frames[1:]:
        whole = whole.unionByName(more)
    return whole


def _settled(done: list[DataFrame]) -> DataFrame:
    """Templates that have arrived, but for roots, which point nowhere."""
    return _union(done[1:])


def _open(hops: DataFrame, done: list[DataFrame], turn: int) -> DataFrame:
    """Templates that may still move on."""
    return hops if turn == 1 else hops.join(_settled(done).select("id").hint("merge"), "id", "left_anti")
