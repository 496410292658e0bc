"""Lookup joins that hold when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicegate.sources.workspace import BROADCAST_BYTES, broadcast_if_small, materialise, sized

# A key with at least this many rows is hot. The hot keys of a table hold at most
# (bytes of the key columns) / HOT_ROWS: 100 MB for 100 TB, so they can be broadcast.
HOT_ROWS = 1_000_000
SPREAD = 256

# Rows are first counted by this many hashes of their key; far fewer rows than HOT_ROWS share
# one by chance, up to some 10 billion rows.
KEY_BINS = 1 << 16

_HOT, _SLOT = "_hot", "_slot"


def slot(spread_by: Column, slots: int = SPREAD) -> Column:
    """Deterministic slot 0..slots-1, so that a recomputed task spreads rows alike."""
    return F.pmod(F.xxhash64(spread_by), F.lit(slots))


def _hot_keys(rows: DataFrame, on: Sequence[str], hot_rows: int) -> DataFrame | None:
    """Keys with at least `hot_rows` rows, None if there are none.

    Counts per hash of the key, which are few and combined before their shuffle, tell where
    such keys can be; only rows there are counted by the key itself, so that the keys of a
    table without hot ones are not shuffled. Starts a job.
    """
    bin_of = F.pmod(F.xxhash64(*on), F.lit(KEY_BINS))
    full = rows.groupBy(bin_of.alias("_bin")).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") >= hot_rows)
    bins = [r["_bin"] for r in full.select("_bin").collect()]
    if not bins:
        return None
    return (
        rows.filter(bin_of.isin(bins))
        .groupBy(*on)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") >= hot_rows)
        .select(*on)
    )


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    spread_by: str,
    how: str = "left",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join `left` to a lookup with at most one row per key.

    The rows of hot keys are dealt over `SPREAD` slots, and only their lookup rows are
    repeated per slot; all other keys join as usual. Rows with a NULL key match nothing
    and are dealt out too. `spread_by` is a column of `left` that differs within a key.
    The hot keys are counted and stored when this is called, and broadcast if they measure
    small, which they do for all but tiny values of `hot_rows`.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"unsupported lookup join: {how}")
    on = list(on)
    hot = _hot_keys(left, on, hot_rows)
    if hot is None:
        return left.join(right, on, how)
    hot = broadcast_if_small(materialise(hot.select(*on, F.lit(True).alias(_HOT)), "hot_keys"))
    keyless = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in on])
    marked = left.join(hot, on, "left").withColumn(
        _SLOT, F.when(F.col(_HOT) | keyless, slot(F.col(spread_by))).otherwise(F.lit(0).cast("bigint"))
    )
    slots = F.when(F.col(_HOT), F.sequence(F.lit(0).cast("bigint"), F.lit(SPREAD - 1).cast("bigint"))).otherwise(
        F.array(F.lit(0).cast("bigint"))
    )
    spread = right.join(hot, on, "left").withColumn(_SLOT, F.explode(slots)).drop(_HOT)
    return marked.join(spread, [*on, _SLOT], how).drop(_HOT, _SLOT)


def measured_lookup(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    spread_by: str,
    how: str = "left",
    hot_rows: int = HOT_ROWS,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """`lookup_join` to a lookup that was materialised: a broadcast if its measured size
    allows one, which no key can skew, else the spread join."""
    side = sized(right, limit)
    if side is not None:
        return left.join(side, list(on), how)
    return lookup_join(left, right, on, spread_by, how, hot_rows)


def repeated_keys(
    rows: DataFrame,
    on: Sequence[str],
    spread_by: str,
    hot_rows: int = HOT_ROWS,
    limit: int = BROADCAST_BYTES,
    folder: str | None = None,
) -> DataFrame:
    """Rows whose key occurs more than once, every member of a group included.

    The repeated keys are counted (combined before their shuffle) and stored when this is
    called. Few of them: they are broadcast and the rows do not move again. Many: the rows
    join them in a shuffle, where hot keys, being repeated by definition, are decided by
    a bounded broadcast and only spread out of the way of the others.
    """
    on = list(on)
    counts = materialise(
        rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > 1),
        "repeated_keys",
        folder,
    )
    few = sized(counts.select(*on), limit)
    if few is not None:
        return rows.join(few, on, "left_semi").select(*rows.columns)
    hot = broadcast_if_small(counts.filter(F.col("_rows") >= hot_rows).select(*on, F.lit(True).alias(_HOT)))
    # Slot 0, but not as a literal: a literal would be folded out of the join key, and hot
    # rows would meet in one partition after all.
    cold = counts.filter(F.col("_rows") < hot_rows).select(
        *on, F.pmod(F.col("_rows"), F.lit(1).cast("bigint")).alias(_SLOT), F.lit(True).alias("_repeated")
    )
    marked = rows.join(hot, on, "left").withColumn(
        _SLOT, F.when(F.col(_HOT), slot(F.col(spread_by)) + 1).otherwise(F.lit(0).cast("bigint"))
    )
    return (
        marked.join(cold, [*on, _SLOT], "left")
        .filter(F.col(_HOT) | F.col("_repeated"))
        .select(*rows.columns)
    )
