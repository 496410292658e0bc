"""End-to-end ingest of files of one template: gates, scan, validation, verdict, clean
write with expectations and audit columns, error rows, history."""

from __future__ import annotations

import dataclasses
import datetime
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicegate.model import MAX_UPLOAD_BYTES, TemplateConfig
from sluicegate.operators.gates import check_headers, header_errors, upload_gates
from sluicegate.operators.publish import (
    expectations,
    meets_all,
    observe_expectations,
    observed_log,
    with_audit_columns,
)
from sluicegate.operators.validate import ROW_COLUMN, clean_rows, unique_errors, validate, verdict
from sluicegate.sources.files import (
    FILE,
    FILE_NAME,
    NumberedScan,
    data_rows,
    every_file,
    header_rows,
    number_records,
    open_quotes,
    path_below,
    plain_path,
    record_counts,
    scan_csv,
)
from sluicegate.sources.records import OPEN_LINE, RecordScan, can_scan, scan_records
from sluicegate.sources.sinks import write_errors, write_target, write_validated
from sluicegate.sources.workspace import bound_listings, broadcast_if_small, materialise, new_folder, remove_folder, sized

COLUMN_FIELDS = "template_id string, column_name string, column_order int"
STEPS = ("file_uploaded", "schema_validated", "constraints_checked", "writing_to_catalog")


@dataclass(frozen=True)
class IngestContext:
    """Where a run writes and on whose behalf. `upload_id` is an SQL expression over `path`
    that gives the identity of the upload, and `source_file` one for the name in the audit
    columns (default of both: the path below the folder that is read, which for a file right
    in it is its name). `log_path` takes the log of expectations (default: beside the history)."""

    uploaded_by: str
    uploaded_at: str
    errors_path: str
    history_path: str
    target_path: str | None = None
    target_table: str | None = None
    validated_path: str | None = None
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    fmt: str = "parquet"
    max_bytes: int = MAX_UPLOAD_BYTES
    checks: Mapping[str, str] = field(default_factory=dict)
    upload_id: str | None = None
    source_file: str | None = None
    log_path: str | None = None
    slice: tuple[str, str] | None = None  # partition of the target that this run replaces


@dataclass(frozen=True)
class IngestResult:
    run_id: str
    verdicts: DataFrame
    errors: DataFrame
    rejected_files: DataFrame
    log: list[tuple[str, int, int, int]]
    wrote: bool
    folder: str

    def release(self) -> None:
        """Remove the stored verdicts and file list, once they are not needed any more."""
        remove_folder(self.verdicts.sparkSession, self.folder)


def _config_frames(spark: SparkSession, cfg: TemplateConfig) -> tuple[DataFrame, DataFrame]:
    template_id = str(cfg.template_id)
    columns = spark.createDataFrame(
        [(template_id, c.column_name, c.column_order) for c in cfg.columns], COLUMN_FIELDS
    )
    templates = spark.createDataFrame(
        [(template_id, str(cfg.bad_row_threshold), cfg.bad_row_action)],
        "template_id string, bad_row_threshold string, bad_row_action string",
    ).withColumn("bad_row_threshold", F.col("bad_row_threshold").cast("decimal(5,2)"))
    return columns, templates


def ingest(spark: SparkSession, paths: str | Sequence[str], cfg: TemplateConfig, ctx: IngestContext) -> IngestResult:
    """Validate every file below `paths` and write the clean rows of those that pass.

    The text is read and parsed once (twice in encodings other than UTF-8 and ISO-8859-1);
    everything after reads the staged columns. Each frame used
    more than once (staged records, errors, verdicts) is a table in the shared folder, so
    a lost executor repeats tasks, not the scan.
    """
    bound_listings(spark)
    template_id = str(cfg.template_id)
    columns, templates = _config_frames(spark, cfg)
    times = {STEPS[0]: ctx.uploaded_at}
    if ctx.upload_id is None or ctx.source_file is None:
        below = path_below(spark, *([paths] if isinstance(paths, str) else paths))
        ctx = dataclasses.replace(ctx, upload_id=ctx.upload_id or below, source_file=ctx.source_file or below)

    listed = every_file(spark, paths)
    # What the result gives out stays until it is released; the rest goes at the end.
    staging, kept = new_folder(spark, "ingest"), new_folder(spark, "ingest-result")
    gated = materialise(
        upload_gates(listed, ctx.max_bytes, ("csv",)).select(
            F.expr(ctx.upload_id).alias("upload_id"), "path", "length", "modificationTime", "gate"
        ),
        "files",
        kept,
    )
    same = gated.groupBy("upload_id").agg(F.count(F.lit(1)).alias("files")).filter("files > 1")
    if twice := [r["upload_id"] for r in same.limit(5).collect()]:
        raise ValueError(f"several files have the same upload id: {twice}")
    _write_start(gated, template_id, ctx)
    accepted = gated.filter(F.col("gate") == "ok")
    rejected = gated.filter(F.col("gate") != "ok")
    uploads = accepted.select("upload_id", F.lit(template_id).alias("template_id"))

    only = {"pathGlobFilter": "*.[cC][sS][vV]"}
    scanned = scan_records(spark, paths, cfg, staging, ctx.max_bytes, **only) if can_scan(cfg) else None
    scan = scan_csv(spark, paths, cfg, max_bytes=ctx.max_bytes, **only) if scanned is None else scanned.rows
    numbered = number_records(scan, folder=staging, upload_id=ctx.upload_id, source_file=ctx.source_file)
    broken = _unread_quotes(spark, paths, cfg, scanned, numbered, staging, only)
    if broken is not None:
        broken = materialise(_quote_errors(broken, cfg, ctx), "open_quotes", staging)

    found = header_rows(numbered.rows, cfg).select("upload_id", "header")
    judged = uploads.join(broken.select("upload_id"), "upload_id", "left_anti") if cfg.multi_line and broken is not None else uploads
    headers = judged.join(found, "upload_id", "left").withColumn(
        "header", F.coalesce("header", F.array().cast("array<string>"))
    )
    checked = materialise(check_headers(headers, columns), "headers", staging)
    bad_headers = checked.filter(~F.col("header_ok")).select("upload_id")
    file_errors = header_errors(checked)
    if broken is not None:
        broken = broken.join(bad_headers, "upload_id", "left_anti")
        bad_headers = bad_headers.unionByName(broken.select("upload_id"))
        file_errors = file_errors.unionByName(broken)
    bad_headers = materialise(bad_headers, "bad_headers", staging)
    times[STEPS[1]] = _now()

    rows = data_rows(numbered.rows).join(broadcast_if_small(bad_headers), "upload_id", "left_anti")
    twice_found = unique_errors(rows, cfg, staging) if cfg.unique else None
    errors = write_errors(
        validate(rows, cfg, twice_found).unionByName(file_errors), ctx.errors_path, ctx.run_id
    )
    verdicts = materialise(
        verdict(
            record_counts(numbered.splits).withColumn("template_id", F.lit(template_id)),
            errors,
            F.broadcast(templates),  # one row
            uploads,
        ),
        "verdicts",
        kept,
    )

    times[STEPS[2]] = times[STEPS[3]] = _now()

    passing = verdicts.filter(F.col("outcome") != "failed")
    if cfg.write_mode == "overwrite":
        # Uploads replace each other: the newest passing file is what remains.
        newest = (
            accepted.join(passing.select("upload_id"), "upload_id", "left_semi")
            .agg(F.max_by("upload_id", F.struct("modificationTime", "upload_id")).alias("upload_id"))
        )
        passing = passing.join(newest, "upload_id", "left_semi")
    passing = materialise(passing, "passing", staging)
    wrote = not passing.isEmpty()
    log: list[tuple[str, int, int, int]] = []
    if wrote:
        repeated, few = None, None
        if cfg.unique:
            repeated = errors.filter(F.col("error_type") == "UNIQUE").select("upload_id", "row_number").distinct()
            few = sized(repeated)
            repeated = repeated if few is None else few
        keep = ("upload_id", "row_number", FILE_NAME)
        clean = clean_rows(rows, cfg, broadcast_if_small(passing), repeated, keep)
        if ctx.validated_path:
            # A folder per run, so that what is read back is what this run wrote.
            folder = f"{ctx.validated_path.rstrip('/')}/run_id={ctx.run_id}"
            write_validated(clean, folder, ctx.fmt, scattered=bool(cfg.unique) and few is None)
            clean = spark.read.schema(clean.schema).format(ctx.fmt).load(folder)
        rules = expectations(cfg, ctx.checks)
        observed, observation = observe_expectations(clean, rules, f"expectations_{ctx.run_id}")
        target = with_audit_columns(observed, ctx.uploaded_by, ctx.uploaded_at, F.col(FILE_NAME))
        if ctx.slice:
            target = target.withColumn(ctx.slice[0], F.lit(ctx.slice[1]))
        write_target(
            target,
            cfg,
            path=ctx.target_path,
            table=ctx.target_table,
            fmt=ctx.fmt,
            slice_column=ctx.slice[0] if ctx.slice else None,
        )
        log = observed_log(observation, rules)
        _write_log(spark, log, template_id, ctx)
        written = passing.select("upload_id", F.col("valid_rows").alias("written_rows"))
        if any(dropped for *_, dropped in log):
            counted = clean.filter(meets_all(rules)).groupBy("upload_id").agg(F.count(F.lit(1)).alias("written_rows"))
            written = written.drop("written_rows").join(counted, "upload_id", "left").fillna(0, ["written_rows"])
    else:
        written = passing.select("upload_id", F.lit(0).cast("bigint").alias("written_rows"))

    _write_end(verdicts, written, bad_headers, rejected, template_id, ctx, times)
    remove_folder(spark, staging)  # as large as the input; a failed run leaves it for inspection
    return IngestResult(ctx.run_id, verdicts, errors, rejected, log, wrote, kept)


COUNTS = ("total_rows", "valid_rows", "invalid_rows", "dropped_rows", "written_rows")


def _now() -> str:
    return datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%fZ")


def _unread_quotes(
    spark: SparkSession,
    paths: str | Sequence[str],
    cfg: TemplateConfig,
    scanned: RecordScan | None,
    numbered: NumberedScan,
    staging: str,
    only: dict[str, str],
) -> DataFrame | None:
    """Files with a quoted cell that is not closed (path, line). They come from the scan itself,
    but for encodings that only the CSV source reads; those with line breaks in their cells
    are not looked at."""
    if scanned is None:
        return None if cfg.multi_line else open_quotes(numbered.staged, cfg, paths, staging, encoding=cfg.encoding, **only)
    if cfg.multi_line:
        return scanned.unclosed.select("path", F.lit(None).cast("string").alias("line"))
    opened = numbered.staged.filter(F.col(OPEN_LINE).isNotNull())
    return opened.select(plain_path(F.col(FILE)).alias("path"), F.col(OPEN_LINE).alias("line"))


def _quote_errors(lines: DataFrame, cfg: TemplateConfig, ctx: IngestContext) -> DataFrame:
    """One error for each upload with an open quote, in the row of the file as a whole."""
    where = "in its file" if cfg.multi_line else "in its line, and the template is not multi-line"
    return (
        lines.select(F.expr(ctx.upload_id).alias("upload_id"), "line")
        .groupBy("upload_id")
        .agg(F.min("line").alias("raw_value"))
        .select(
            "upload_id",
            F.lit(0).cast("bigint").alias("row_number"),
            F.lit(ROW_COLUMN).alias("column_name"),
            F.lit("SCHEMA_MISMATCH").alias("error_type"),
            F.lit(f"A quoted cell is not closed {where}").alias("error_message"),
            "raw_value",
        )
    )


def _write_log(spark: SparkSession, log: list[tuple[str, int, int, int]], template_id: str, ctx: IngestContext) -> None:
    """The expectation log of the run, a row per expectation; a repeated run replaces it."""
    entries = [(template_id, ctx.uploaded_by, *entry) for entry in log]
    schema = "template_id string, uploaded_by string, rule string, processed long, passed long, dropped long"
    folder = ctx.log_path or f"{ctx.history_path.rstrip('/')}_expectations"
    rows = spark.createDataFrame(entries, schema)
    rows.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/run_id={ctx.run_id}")


def _write_start(files: DataFrame, template_id: str, ctx: IngestContext) -> None:
    """The first event of every file of the run, so that a run that dies leaves a trace."""
    events = files.select(
        "upload_id",
        F.lit(template_id).alias("template_id"),
        F.lit(0).alias("step"),
        F.lit(STEPS[0]).alias("status"),
        F.lit(ctx.uploaded_at).alias("at"),
        *[F.lit(None).cast("bigint").alias(c) for c in COUNTS],
    )
    _write_events(events, ctx, "start")


def _write_end(
    verdicts: DataFrame,
    written: DataFrame,
    bad_files: DataFrame,
    rejected: DataFrame,
    template_id: str,
    ctx: IngestContext,
    times: dict[str, str],
) -> None:
    """The other steps of judged uploads with their counts, and the failure of rejected
    files. An upload whose file is wrong as a whole fails before its schema is accepted; one
    that breaks its threshold has had its constraints checked."""
    end = _now()
    step = lambda name, at: F.struct(F.lit(name).alias("status"), F.lit(at).alias("at"))
    checked = [step(name, times[name]) for name in STEPS[1:3]]
    reached = (
        F.when(F.col("_bad_file"), F.array().cast("array<struct<status:string,at:string>>"))
        .when(F.col("outcome") == "failed", F.array(*checked))
        .otherwise(F.array(*checked, step(STEPS[3], times[STEPS[3]])))
    )
    last = F.struct(F.col("outcome").alias("status"), F.lit(end).alias("at"))
    judged = (
        verdicts.join(written, "upload_id", "left")
        .join(bad_files.select("upload_id", F.lit(True).alias("_bad_file")).distinct(), "upload_id", "left")
        .fillna(0, ["written_rows"])
        .fillna(False, ["_bad_file"])
        .select("upload_id", "template_id", F.posexplode(F.concat(reached, F.array(last))).alias("position", "e"), *COUNTS)
        .select("upload_id", "template_id", (F.col("position") + 1).alias("step"), "e.status", "e.at", *COUNTS)
    )
    refused = rejected.select(
        "upload_id",
        F.lit(template_id).alias("template_id"),
        F.lit(1).alias("step"),
        F.lit("failed").alias("status"),
        F.lit(end).alias("at"),
        *[F.lit(None).cast("bigint").alias(c) for c in COUNTS],
    )
    _write_events(judged.unionByName(refused), ctx, "end")


def _write_events(events: DataFrame, ctx: IngestContext, stage: str) -> None:
    """Append step events (upload_id, template_id, event_id, ts, status, uploaded_by,
    counts); a repeated run replaces its own."""
    rows = events.select(
        "upload_id",
        "template_id",
        F.col("step").cast("bigint").alias("event_id"),
        F.greatest(F.col("at").cast("timestamp"), F.lit(ctx.uploaded_at).cast("timestamp")).alias("ts"),
        "status",
        F.lit(ctx.uploaded_by).alias("uploaded_by"),
        *COUNTS,
    )
    rows.write.mode("overwrite").parquet(f"{ctx.history_path.rstrip('/')}/run_id={ctx.run_id}/stage={stage}")
