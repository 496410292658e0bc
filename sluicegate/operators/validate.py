"""File validation: cell rules, error report, verdict, clean rows.

Frames of uploaded rows carry `upload_id`, `row_number` and the template's columns as
STRING; rows read by `scan_csv` also carry `_ragged`. All uploads of a template are
validated together.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicegate.functions.cells import castable, is_blank, typed
from sluicegate.model import ColumnConfig, TemplateConfig
from sluicegate.plans.skew import HOT_ROWS, repeated_keys
from sluicegate.sources.files import RAGGED
from sluicegate.sources.records import GARBLED
from sluicegate.sources.workspace import BROADCAST_BYTES

ERROR_COLUMNS = ("upload_id", "row_number", "column_name", "error_type", "error_message", "raw_value")
ROW_COLUMN = "_row"  # column name of errors that concern the whole record
REPLACEMENT = "\N{REPLACEMENT CHARACTER}"


@dataclass(frozen=True)
class CellRule:
    """`broken` is never NULL; `error` is the struct reported for it."""

    error_type: str
    broken: Column
    error: Column


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def _error(error_type: str, column_name: str, message: Column, raw: Column) -> Column:
    return F.struct(
        F.lit(column_name).alias("column_name"),
        F.lit(error_type).alias("error_type"),
        message.alias("error_message"),
        raw.alias("raw_value"),
    )


def _undecodable(df: DataFrame, value: Column) -> Column:
    """True for cells in which the reader had to replace bytes. Rows that were read from files
    say whether their bytes were wrong; a replacement character among right ones is text."""
    replaced = F.coalesce(F.contains(value, F.lit(REPLACEMENT)), F.lit(False))
    return replaced & F.col(GARBLED) if GARBLED in df.columns else replaced


def _whole(df: DataFrame) -> Column:
    """True for records with the template's number of fields."""
    return F.col(RAGGED).isNull() if RAGGED in df.columns else F.lit(True)


def cell_rules(df: DataFrame, cfg: TemplateConfig) -> list[CellRule]:
    """All rules that need one row only. They end up in a single projection."""
    rules: list[CellRule] = []
    whole = _whole(df)
    if RAGGED in df.columns:
        rules.append(
            CellRule(
                "SCHEMA_MISMATCH",
                F.col(RAGGED).isNotNull(),
                _error(
                    "SCHEMA_MISMATCH",
                    ROW_COLUMN,
                    F.lit(f"Record does not have {len(cfg.columns)} fields"),
                    F.col(RAGGED),
                ),
            )
        )
    for c in cfg.included:
        v = _quoted(c.column_name)
        garbled = whole & _undecodable(df, v)
        rules.append(
            CellRule(
                "ENCODING_ERROR",
                garbled,
                _error("ENCODING_ERROR", c.column_name, F.lit(f"Value is not valid {cfg.encoding}"), v),
            )
        )
        if not c.is_nullable:
            rules.append(
                CellRule(
                    "NOT_NULL",
                    whole & is_blank(v),
                    _error("NOT_NULL", c.column_name, F.lit("Value is required"), v),
                )
            )
        if not isinstance(c.type, T.StringType):
            rules.append(
                CellRule(
                    "TYPE_MISMATCH",
                    whole & ~_undecodable(df, v) & ~is_blank(v) & ~castable(v, c.type),
                    _error("TYPE_MISMATCH", c.column_name, F.lit(f"Value is not a valid {c.data_type}"), v),
                )
            )
    return rules


def _any(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def is_bad_row(df: DataFrame, cfg: TemplateConfig) -> Column:
    """True where some rule of `cell_rules` is broken, with one cast per cell: a blank
    cell never casts, so required cells need no test of their own."""
    tests = [~_whole(df)]
    for c in cfg.included:
        v = _quoted(c.column_name)
        if isinstance(c.type, T.StringType):
            unusable = F.lit(False) if c.is_nullable else is_blank(v)
        else:
            unusable = ~castable(v, c.type)
            if c.is_nullable:
                unusable = unusable & ~is_blank(v)
        tests.append(unusable | _undecodable(df, v))
    return _any(tests)


def cell_errors(df: DataFrame, cfg: TemplateConfig, error_types: Sequence[str] | None = None) -> DataFrame:
    """Errors of the one-row rules, one row per bad cell. Good rows leave at the filter,
    so only bad ones are unfolded."""
    rules = [r for r in cell_rules(df, cfg) if error_types is None or r.error_type in error_types]
    bad = is_bad_row(df, cfg) if error_types is None else _any([r.broken for r in rules])
    if not rules:
        rules = [CellRule("NOT_NULL", F.lit(False), _error("NOT_NULL", ROW_COLUMN, F.lit(""), F.lit("")))]
    return (
        df.filter(bad)
        .select("upload_id", "row_number", F.explode(F.array(*[F.when(r.broken, r.error) for r in rules])).alias("e"))
        .filter(F.col("e").isNotNull())
        .select("upload_id", "row_number", "e.column_name", "e.error_type", "e.error_message", "e.raw_value")
    )


def ragged_errors(df: DataFrame, cfg: TemplateConfig) -> DataFrame:
    return cell_errors(df, cfg, ["SCHEMA_MISMATCH"])


def encoding_errors(df: DataFrame, cfg: TemplateConfig) -> DataFrame:
    return cell_errors(df, cfg, ["ENCODING_ERROR"])


def type_errors(df: DataFrame, cfg: TemplateConfig) -> DataFrame:
    return cell_errors(df, cfg, ["TYPE_MISMATCH"])


def not_null_errors(df: DataFrame, cfg: TemplateConfig) -> DataFrame:
    return cell_errors(df, cfg, ["NOT_NULL"])


def unique_cells(df: DataFrame, cfg: TemplateConfig) -> DataFrame:
    """Non-blank cells of all unique columns in one long frame:
    (upload_id, row_number, column_name, value, raw_value), value being trimmed."""

    def cell(c: ColumnConfig) -> Column:
        v = _quoted(c.column_name)
        return F.struct(F.lit(c.column_name).alias("column_name"), F.trim(v).alias("value"), v.alias("raw_value"))

    usable = df.filter(_whole(df))
    kept = ["upload_id", "row_number", *([GARBLED] if GARBLED in df.columns else [])]
    if len(cfg.unique) == 1:
        (only,) = cfg.unique
        long = usable.select(*kept, cell(only).alias("c"))
    else:
        long = usable.select(*kept, F.explode(F.array(*[cell(c) for c in cfg.unique])).alias("c"))
    long = long.select(*kept, "c.column_name", "c.value", "c.raw_value")
    long = long.filter(~is_blank("value") & ~_undecodable(long, F.col("value")))
    return long.select("upload_id", "row_number", "column_name", "value", "raw_value")


def check_unique(
    cells: DataFrame, hot_rows: int = HOT_ROWS, limit: int = BROADCAST_BYTES, folder: str | None = None
) -> DataFrame:
    """Cells whose value occurs more than once in its upload and column; every member of
    a group is returned. One shuffle of the cells serves any number of columns, and the
    rows themselves move only if very many values are repeated (see `repeated_keys`).
    Starts a job."""
    return repeated_keys(cells, ["upload_id", "column_name", "value"], "row_number", hot_rows, limit, folder)


def unique_errors(df: DataFrame, cfg: TemplateConfig, folder: str | None = None) -> DataFrame:
    """UNIQUE errors. Starts a job; its table of repeated values is put into `folder` if one
    is given, to be removed with it."""
    return check_unique(unique_cells(df, cfg), folder=folder).select(
        "upload_id",
        "row_number",
        "column_name",
        F.lit("UNIQUE").alias("error_type"),
        F.lit("Value occurs more than once").alias("error_message"),
        "raw_value",
    )


def validate(df: DataFrame, cfg: TemplateConfig, repeated: DataFrame | None = None) -> DataFrame:
    """The error report: one row per bad cell. `repeated` passes UNIQUE errors that the
    caller has at hand."""
    errors = cell_errors(df, cfg)
    if cfg.unique:
        errors = errors.unionByName(unique_errors(df, cfg) if repeated is None else repeated)
    return errors


def verdict(
    rows: DataFrame, errors: DataFrame, templates: DataFrame, uploads: DataFrame | None = None
) -> DataFrame:
    """One row per upload: counts of rows (not cells), share of bad rows, outcome.

    `rows`: upload_id, template_id per data row, or counted already as `total_rows` per
    upload; `templates`: template_id, bad_row_threshold, bad_row_action; `uploads`
    (upload_id, template_id) adds uploads without any data row. An error in row 0
    concerns the file as a whole, like its header, and fails the upload; none of its rows
    count as valid then.
    """
    count = F.sum("total_rows") if "total_rows" in rows.columns else F.count(F.lit(1))
    totals = rows.groupBy("upload_id", "template_id").agg(count.alias("total_rows"))
    if uploads is not None:
        totals = (
            uploads.select("upload_id", "template_id")
            .join(totals, ["upload_id", "template_id"], "left")
            .withColumn("total_rows", F.coalesce("total_rows", F.lit(0).cast("bigint")))
        )
    # Distinct on (upload, row) first: no upload is ever one group of rows.
    faults = (
        errors.select("upload_id", "row_number")
        .distinct()
        .groupBy("upload_id")
        .agg(
            F.count_if(F.col("row_number") > 0).alias("invalid_rows"),
            F.max(F.col("row_number") == 0).alias("bad_header"),
        )
    )
    judged = (
        totals.join(faults, "upload_id", "left")
        .join(templates.select("template_id", "bad_row_threshold", "bad_row_action"), "template_id")
        .withColumn("invalid_rows", F.coalesce("invalid_rows", F.lit(0).cast("bigint")))
        .withColumn("bad_header", F.coalesce("bad_header", F.lit(False)))
    )
    over = F.col("invalid_rows") * 100 > F.col("bad_row_threshold") * F.col("total_rows")
    failed = F.col("bad_header") | over | ((F.col("bad_row_action") == "fail") & (F.col("invalid_rows") > 0))
    outcome = F.when(failed, "failed").when(F.col("invalid_rows") > 0, "partial").otherwise("completed")
    return judged.select(
        "upload_id",
        "template_id",
        "total_rows",
        "invalid_rows",
        F.when(F.col("bad_header"), F.lit(0).cast("bigint"))
        .otherwise(F.col("total_rows") - F.col("invalid_rows"))
        .alias("valid_rows"),
        F.when(outcome == "partial", F.col("invalid_rows")).otherwise(F.lit(0).cast("bigint")).alias("dropped_rows"),
        F.when(F.col("total_rows") == 0, F.lit(0.0))
        .otherwise((F.col("invalid_rows") * 100).cast("double") / F.greatest("total_rows", F.lit(1).cast("bigint")))
        .alias("bad_pct"),
        outcome.alias("outcome"),
    )


def typed_rows(df: DataFrame, cfg: TemplateConfig, keep: Sequence[str] = ("upload_id", "row_number")) -> DataFrame:
    """Included columns as their target types; blank cells become NULL."""
    return df.select(
        *keep, *[typed(_quoted(c.column_name), c.type).alias(c.column_name) for c in cfg.included]
    )


def clean_rows(
    df: DataFrame,
    cfg: TemplateConfig,
    verdicts: DataFrame,
    repeated: DataFrame | None = None,
    keep: Sequence[str] = ("upload_id", "row_number"),
) -> DataFrame:
    """Valid rows of passing uploads, typed.

    The one-row rules are evaluated again in place: that is a filter, where removing the
    reported rows would shuffle the whole data. `repeated` holds the UNIQUE errors
    (upload_id, row_number); without it they are computed for templates that need them.
    """
    passing = verdicts.filter(F.col("outcome") != "failed").select("upload_id")
    rows = df.filter(~is_bad_row(df, cfg)).join(passing, "upload_id", "left_semi")
    if cfg.unique:
        if repeated is None:
            repeated = unique_errors(df, cfg)
        rows = rows.join(repeated.select("upload_id", "row_number"), ["upload_id", "row_number"], "left_anti")
    return typed_rows(rows, cfg, keep)
