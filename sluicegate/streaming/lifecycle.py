"""Template status and reminders over a stream of lifecycle events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sluicegate.model import REMINDER_DAYS
from sluicegate.streaming.slices import SlicedTable, run_batches

_STATE = "template_id bigint, status string, changed_at timestamp_ntz, event_id bigint, newest timestamp_ntz, n_events bigint"
_REMINDER = "template_id bigint, pending_since timestamp_ntz, reminded_at timestamp_ntz"
WAITING = "Pending Approval"


class LifecycleTables:
    """The status of every template, and a reminder once for each wait that grows too long.

    A batch is reduced to one row per template, combined in each task, and folded into the
    state that the batch before it left: a slice per batch, of which the last two stay. So
    events that come late or out of order change nothing that a newer event decided, and a
    repeated batch replaces its slices. Time is the newest event seen: a template that has
    been waiting for approval for more than `days` days then is due, and reminded of unless
    it was for the same wait.
    """

    def __init__(self, spark: SparkSession, folder: str, days: int = REMINDER_DAYS):
        self.state = SlicedTable(spark, f"{folder}/state", _STATE)
        self.sent = SlicedTable(spark, f"{folder}/reminders", _REMINDER)
        self.days = days

    def follow(self, events: DataFrame, checkpoint: str) -> StreamingQuery:
        """Take all there is of a stream of (template_id, ts, event_id, to_status)."""
        return run_batches(events, self.add, checkpoint)

    def add(self, batch: DataFrame, batch_id: int) -> None:
        new = batch.select(
            F.col("template_id").cast("bigint").alias("template_id"),
            F.col("to_status").alias("status"),
            F.col("ts").cast("timestamp_ntz").alias("changed_at"),
            F.col("event_id").cast("bigint").alias("event_id"),
            F.col("ts").cast("timestamp_ntz").alias("newest"),
            F.lit(1).cast("bigint").alias("n_events"),
        )
        moment = F.struct("changed_at", "event_id")
        folded = (
            new.unionByName(self.state.one(batch_id - 1))
            .groupBy("template_id")
            .agg(
                F.max_by(F.struct("status", "changed_at", "event_id"), moment).alias("last"),
                F.max("newest").alias("newest"),
                F.sum("n_events").alias("n_events"),
            )
            .select("template_id", "last.status", "last.changed_at", "last.event_id", "newest", "n_events")
        )
        self.state.put(batch_id, folded)
        self.state.drop(batch_id - 2)  # a repeated batch needs the one before it only
        now = self.state.one(batch_id).agg(F.max("newest")).first()[0]
        due = self.state.one(batch_id).filter(F.col("status") == WAITING)
        if now is None:
            due = due.filter("false")
        late = F.col("changed_at") < F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {self.days} DAYS")
        told = self.sent.before(batch_id).select("template_id", F.col("pending_since").alias("changed_at"))
        fresh = due.filter(late).join(told, ["template_id", "changed_at"], "left_anti")
        self.sent.put(
            batch_id,
            fresh.select("template_id", F.col("changed_at").alias("pending_since"), F.lit(now).cast("timestamp_ntz").alias("reminded_at")),
        )

    def _last_batch(self) -> int:
        return self.state.all().agg(F.max("batch")).first()[0] or 0

    def status(self) -> DataFrame:
        """(template_id, status, changed_at, n_events), as `replay_status` of all events so far."""
        return self.state.one(self._last_batch()).select("template_id", "status", "changed_at", "n_events")

    def reminders(self) -> DataFrame:
        """(template_id, pending_since, reminded_at): all reminders so far."""
        return self.sent.all().drop("batch")
