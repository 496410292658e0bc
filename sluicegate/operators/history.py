"""Upload history: step events, progress, listing, quality over time, error summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluicegate.model import FINISHED_UPLOAD_STATUSES

# Step number shown for each status; failure has no step of its own.
STEPS = (
    ("file_uploaded", 1),
    ("schema_validated", 2),
    ("constraints_checked", 3),
    ("writing_to_catalog", 4),
    ("completed", 4),
    ("partial", 4),
)
FAILED = "failed"


def current_uploads(
    events: DataFrame, key: str = "upload_id", order: Sequence[str] = ("ts", "event_id")
) -> DataFrame:
    """The newest event of each upload plus `n_events`. History is append-only, so every
    attempt stays and the current row is an aggregate."""
    rest = [c for c in events.columns if c != key]
    return (
        events.groupBy(key)
        .agg(
            F.max_by(F.struct(*rest), F.struct(*order)).alias("latest"),
            F.count(F.lit(1)).alias("n_events"),
        )
        .select(key, *[F.col(f"latest.{c}").alias(c) for c in rest], "n_events")
    )


def upload_progress(events: DataFrame) -> DataFrame:
    """(upload_id, status, step_number, is_terminal): the last step reached; a failure is
    final, and steps reported after it do not count. One aggregation."""
    moment = F.struct("ts", "event_id")

    def first(status: str) -> Column:
        return F.min(F.when(F.col("status") == status, moment))

    seen = events.groupBy("upload_id").agg(
        first(FAILED).alias("failure"),
        F.max_by("status", moment).alias("newest"),
        *[first(name).alias(name) for name, _ in STEPS],
    )
    in_time = [
        F.when(
            F.col(name).isNotNull() & (F.col("failure").isNull() | (F.col(name) < F.col("failure"))), F.lit(number)
        ).otherwise(0)
        for name, number in STEPS
    ]
    status = F.when(F.col("failure").isNotNull(), FAILED).otherwise(F.col("newest"))
    return seen.select(
        "upload_id",
        status.alias("status"),
        F.greatest(*in_time).alias("step_number"),
        status.isin(*FINISHED_UPLOAD_STATUSES).alias("is_terminal"),
    )


def list_uploads(
    history: DataFrame,
    template_id=None,
    uploaded_by: str | None = None,
    status: str | None = None,
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """One page of upload attempts, newest first."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be 1..200 and offset not negative")
    wanted = {"template_id": template_id, "uploaded_by": uploaded_by, "status": status}
    for name, value in wanted.items():
        if value is not None:
            history = history.filter(F.col(name) == value)
    return history.orderBy(F.col("uploaded_at").desc(), "id").offset(offset).limit(limit)


def quality_by_day(history: DataFrame) -> DataFrame:
    """Rows, dropped rows and dropped share per template and day. Works on a stream that
    has a watermark on `uploaded_at`."""
    daily = history.groupBy("template_id", F.window("uploaded_at", "1 day").alias("w")).agg(
        F.count(F.lit(1)).alias("uploads"),
        F.sum("total_rows").alias("total_rows"),
        F.sum("dropped_rows").alias("dropped_rows"),
    )
    return quality_share(daily.withColumn("day", F.col("w.start").cast("date")))


def quality_share(days: DataFrame) -> DataFrame:
    """Sums per template and day with the dropped share."""
    return days.select(
        "template_id",
        "day",
        "uploads",
        "total_rows",
        "dropped_rows",
        F.when(F.col("total_rows") > 0, (F.col("dropped_rows") * 100).cast("double") / F.col("total_rows"))
        .otherwise(F.lit(0.0))
        .alias("dropped_pct"),
    )


def upload_results(verdicts: DataFrame, templates: DataFrame, history: DataFrame) -> DataFrame:
    """Message data per finished upload: outcome, counts and the reason.

    `templates`: template_id, name, fully_qualified_name, bad_row_threshold,
    bad_row_action; `history`: upload_id, uploaded_by, uploaded_at.
    """
    over = F.col("invalid_rows") * 100 > F.col("bad_row_threshold") * F.col("total_rows")
    reason = (
        F.when(
            (F.col("outcome") == "failed") & over,
            F.concat(F.lit("Share of bad rows exceeds "), F.col("bad_row_threshold").cast("string"), F.lit(" %")),
        )
        .when(
            (F.col("outcome") == "failed") & (F.col("invalid_rows") > 0),
            F.concat(F.col("invalid_rows").cast("string"), F.lit(" bad rows and the template accepts none")),
        )
        .when(F.col("outcome") == "failed", F.lit("The file header does not match the template"))
        .when(
            F.col("outcome") == "partial", F.concat(F.col("dropped_rows").cast("string"), F.lit(" bad rows dropped"))
        )
    )
    known = templates.select(
        "template_id", "name", "fully_qualified_name", "bad_row_threshold", "bad_row_action"
    )
    return (
        verdicts.join(known, "template_id")
        .join(history.select("upload_id", "uploaded_by", "uploaded_at"), "upload_id")
        .select(
            "upload_id",
            "template_id",
            F.col("name").alias("template_name"),
            "fully_qualified_name",
            "uploaded_by",
            "uploaded_at",
            "outcome",
            "total_rows",
            "valid_rows",
            "invalid_rows",
            "dropped_rows",
            reason.alias("reason"),
        )
    )


def error_summary(errors: DataFrame) -> DataFrame:
    """Per upload, error type and column: errors, rows, and the first bad value."""
    return errors.groupBy("upload_id", "error_type", "column_name").agg(
        F.count(F.lit(1)).alias("errors"),
        F.countDistinct("row_number").alias("bad_rows"),
        F.min("row_number").alias("first_row"),
        F.min_by("raw_value", "row_number").alias("first_value"),
    )


def error_samples(errors: DataFrame, k: int = 5) -> DataFrame:
    """Per upload, error type and column: `samples`, up to `k` bad cells (row_number, raw_value).

    They are those with the smallest digests, so the same however rows are dealt. Each task
    passes on its own `k` of a group, which bounds what a frequent error sends.
    """
    keys = ["upload_id", "error_type", "column_name"]
    digest = F.md5(F.concat(F.col("row_number").cast("string"), F.lit(":"), F.coalesce("raw_value", F.lit(""))))
    drawn = errors.select(*keys, digest.alias("digest"), "row_number", "raw_value")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("digest", "row_number"))
    chosen = drawn.withColumn("rank", rank).filter(F.col("rank") <= k)
    listed = F.array_sort(F.collect_list(F.struct("rank", "row_number", "raw_value")))
    return chosen.groupBy(*keys).agg(
        F.transform(listed, lambda s: F.struct(s["row_number"].alias("row_number"), s["raw_value"].alias("raw_value"))).alias("samples")
    )


def error_totals(errors: DataFrame) -> DataFrame:
    """Errors per type and column with subtotals; a subtotal names its level in `level`:
    0 = type and column, 1 = type, 3 = all."""
    return (
        errors.rollup("error_type", "column_name")
        .agg(
            F.grouping_id().cast("int").alias("level"),
            F.count(F.lit(1)).alias("errors"),
        )
        .select("error_type", "column_name", "level", "errors")
    )


def error_text(errors: DataFrame) -> DataFrame:
    """One text per upload: 'TYPE column: n; ...', types and columns in order. A text has
    at most (error types x template columns) parts."""
    counted = errors.groupBy("upload_id", "error_type", "column_name").agg(F.count(F.lit(1)).alias("n"))
    part = F.concat(F.col("error_type"), F.lit(" "), F.col("column_name"), F.lit(": "), F.col("n").cast("string"))
    return (
        counted.groupBy("upload_id")
        .agg(
            F.sort_array(F.collect_list(F.struct("error_type", "column_name", part.alias("part")))).alias("parts"),
            F.sum("n").alias("errors"),
        )
        .select("upload_id", "errors", F.array_join(F.col("parts.part"), "; ").alias("error_summary"))
    )
