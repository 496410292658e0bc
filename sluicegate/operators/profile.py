"""Column profiles of uploads as mergeable sketches.

A profile is made once per upload and stored; profiles of many uploads are merged without
their rows. Distinct values are HyperLogLog sketches, numbers KLL quantile sketches, and
frequent values counted sketches; all are Spark's own aggregates, combined in each task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicegate.functions.cells import castable, is_blank, typed
from sluicegate.model import spark_type

# 2^LOG_REGISTERS registers (relative error 1.04 / sqrt of their number), and KLL's K (rank error about 1.3 %).
LOG_REGISTERS, QUANTILE_K = 12, 200
DISTINCT_ERROR, RANK_ERROR = 1.04 / 2 ** (LOG_REGISTERS / 2), 0.0133
TOP_TRACKED = 1_000


def profile_columns(rows: DataFrame, columns: Sequence[str], key: str = "upload_id") -> DataFrame:
    """key, column_name, filled, blank, numbers, smallest, largest, distinct_sketch,
    number_sketch, top_sketch: a row per upload and column of all-STRING rows. Blank cells
    are only counted."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("value")) for c in columns]))
    long = rows.select(key, cells.alias("c")).select(key, "c.column_name", F.when(~is_blank("c.value"), F.trim("c.value")).alias("value"))
    double = spark_type("DOUBLE")
    number = F.when(castable("value", double) & ~F.isnan(typed("value", double)), typed("value", double))
    return long.withColumn("number", number).groupBy(key, "column_name").agg(
        F.count("value").alias("filled"),
        F.count_if(F.col("value").isNull()).alias("blank"),
        F.count("number").alias("numbers"),
        F.min("number").alias("smallest"),
        F.max("number").alias("largest"),
        F.hll_sketch_agg("value", F.lit(LOG_REGISTERS)).alias("distinct_sketch"),
        F.kll_sketch_agg_double("number", F.lit(QUANTILE_K)).alias("number_sketch"),
        F.expr(f"approx_top_k_accumulate(value, {TOP_TRACKED})").alias("top_sketch"),
    )


def merge_profiles(profiles: DataFrame, by: Sequence[str] = ("column_name",)) -> DataFrame:
    """Profiles of many uploads as one per `by`."""
    return profiles.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ("filled", "blank", "numbers")],
        F.min("smallest").alias("smallest"),
        F.max("largest").alias("largest"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("number_sketch").alias("number_sketch"),
        F.expr(f"approx_top_k_combine(top_sketch, {TOP_TRACKED})").alias("top_sketch"),
    )


def profile_estimates(profiles: DataFrame, top: int = 5) -> DataFrame:
    """What the sketches say: distinct values (within about three times DISTINCT_ERROR), quartiles
    of the numbers (rank within about RANK_ERROR) and the most frequent values."""
    kept = [c for c in profiles.columns if not c.endswith("_sketch")]
    share = [F.when(F.col("numbers") > 0, F.kll_sketch_get_quantile_double("number_sketch", F.lit(q))) for q in (0.25, 0.5, 0.75)]
    return profiles.select(
        *kept,
        F.when(F.col("filled") > 0, F.hll_sketch_estimate("distinct_sketch")).otherwise(0).alias("distinct_values"),
        *[q.alias(name) for q, name in zip(share, ("lower_quartile", "median", "upper_quartile"))],
        # Blank cells are tracked as NULL.
        F.when(F.col("filled") > 0, F.slice(F.filter(F.expr(f"approx_top_k_estimate(top_sketch, {top + 1})"), lambda t: t["item"].isNotNull()), 1, top)).alias(
            "top_values"
        ),
    )
