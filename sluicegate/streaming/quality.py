"""Upload quality per template and day over a stream of finished uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sluicegate.operators.history import quality_by_day, quality_share
from sluicegate.streaming.slices import SlicedTable, run_batches

_PARTIAL = "template_id bigint, day date, uploads bigint, total_rows bigint, dropped_rows bigint"
_LATE = "template_id bigint, uploaded_at timestamp_ntz, total_rows bigint, dropped_rows bigint"
_SUMS = ("uploads", "total_rows", "dropped_rows")


def quality_stream(history: DataFrame, lateness: str = "1 day") -> DataFrame:
    """`quality_by_day` on a stream: a day is emitted once the watermark has passed it, and
    its state is dropped. Rows later than that are not counted; `QualityTables` counts them."""
    return quality_by_day(history.withWatermark("uploaded_at", lateness))


class QualityTables:
    """Quality per day as a stream adds to it, with nothing lost that comes late.

    A batch adds the sums of each template and day to `days`. Rows of days that the watermark
    (the newest time of all earlier batches less the lateness) had passed go to `late` as
    they are; finished days are not touched, `corrections` says by how much they change. Both
    are one slice per batch, replaced if the batch is repeated, so a restart from the
    checkpoint counts nothing twice. Rows without a time belong to no day and are left out,
    as they are by `quality_by_day`.
    """

    def __init__(self, spark: SparkSession, folder: str, lateness: str = "1 day"):
        self.days = SlicedTable(spark, f"{folder}/days", _PARTIAL)
        self.late = SlicedTable(spark, f"{folder}/late", _LATE)
        self.newest = SlicedTable(spark, f"{folder}/newest", "newest timestamp_ntz")
        self.lateness = lateness

    def follow(self, history: DataFrame, checkpoint: str) -> StreamingQuery:
        """Take all there is of a stream of (template_id, uploaded_at, total_rows, dropped_rows)."""
        return run_batches(history, self.add, checkpoint)

    def add(self, batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(
            F.col("template_id").cast("bigint").alias("template_id"),
            F.col("uploaded_at").cast("timestamp_ntz").alias("uploaded_at"),
            *[F.col(c).cast("bigint").alias(c) for c in _SUMS[1:]],
        ).filter(F.col("uploaded_at").isNotNull())
        newest = self.newest.before(batch_id).agg(F.max("newest")).first()[0]  # one row for each batch
        passed = F.lit(False)
        if newest is not None:
            end = F.date_trunc("day", F.col("uploaded_at")) + F.expr("INTERVAL 1 DAY")
            passed = end <= F.lit(newest) - F.expr(f"INTERVAL {self.lateness}")
        self.late.put(batch_id, rows.filter(passed))
        self.days.put(batch_id, _partial(rows.filter(~passed)))
        self.newest.put(batch_id, rows.agg(F.max("uploaded_at").alias("newest")))

    def finished(self) -> DataFrame:
        """Quality per day without what came late."""
        return quality_share(_summed(self.days.all()))

    def corrections(self) -> DataFrame:
        """(template_id, day) with what late rows add to it."""
        return _partial(self.late.all())

    def corrected(self) -> DataFrame:
        """`quality_by_day` of all rows that have come."""
        return quality_share(_summed(self.days.all().drop("batch").unionByName(self.corrections())))


def _partial(rows: DataFrame) -> DataFrame:
    return rows.groupBy("template_id", F.to_date("uploaded_at").alias("day")).agg(
        F.count(F.lit(1)).alias("uploads"), *[F.sum(c).alias(c) for c in _SUMS[1:]]
    )


def _summed(days: DataFrame) -> DataFrame:
    return days.groupBy("template_id", "day").agg(*[F.sum(c).alias(c) for c in _SUMS])
