"""Target tables, validated files and error rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicegate.model import AUDIT_COLUMNS, TemplateConfig
from sluicegate.sources.workspace import materialise, new_folder, remove_folder

OVERWRITE_MODE = "spark.sql.sources.partitionOverwriteMode"


def target_columns(cfg: TemplateConfig) -> list[str]:
    return [c.column_name for c in cfg.included] + [name for name, _ in AUDIT_COLUMNS]


def write_target(
    df: DataFrame,
    cfg: TemplateConfig,
    mode: str | None = None,
    path: str | None = None,
    table: str | None = None,
    fmt: str = "parquet",
    slice_column: str | None = None,
) -> None:
    """Append to or overwrite the target with exactly its columns; audit columns may be
    missing unless the target is a table that has them.

    An overwrite is staged first, so the rows may come from the target itself, and a job
    that fails while computing them leaves the target as it was. With `slice_column` only
    the slices present in `df` are replaced, which makes a repeated append harmless.

    A table that exists is written into, never made anew: its schema, comments and other
    slices stay. It has to be partitioned by the slice column if one is given.
    """
    mode = mode or cfg.write_mode
    if mode not in ("append", "overwrite"):
        raise ValueError(f"unknown write mode: {mode!r}")
    if (path is None) == (table is None):
        raise ValueError("give either a path or a table")
    needed = [*[c.column_name for c in cfg.included], *([slice_column] if slice_column else [])]
    if missing := [n for n in needed if n not in df.columns]:
        raise ValueError(f"the rows lack target columns: {missing}")
    names = [n for n in (*target_columns(cfg), slice_column) if n in df.columns]
    rows = df.select(*[F.col(f"`{n}`") for n in names])
    spark = df.sparkSession
    staged = None
    if mode == "overwrite":
        staged = new_folder(spark, "overwrite")
        rows = materialise(rows, "rows", staged)
    if table is not None and spark.catalog.tableExists(table):
        _write_into_table(rows, table, mode, slice_column)
    else:
        writer = rows.write.format(fmt)
        if slice_column:
            # Appending a slice means replacing that slice only.
            replaced = "static" if mode == "overwrite" else "dynamic"
            writer = writer.partitionBy(slice_column).option("partitionOverwriteMode", replaced).mode("overwrite")
        else:
            writer = writer.mode(mode)
        writer.save(path) if path is not None else writer.saveAsTable(table)
    if staged:
        remove_folder(spark, staged)


def _write_into_table(rows: DataFrame, table: str, mode: str, slice_column: str | None) -> None:
    """Insert by name into a table that is there, replacing all of it or the slices of `rows`."""
    spark = rows.sparkSession
    known = spark.catalog.listColumns(table)
    names = [c.name for c in known]
    if sorted(n.lower() for n in names) != sorted(n.lower() for n in rows.columns):
        raise ValueError(f"{table} has the columns {names}, the rows have {rows.columns}")
    sliced_by = [c.name.lower() for c in known if c.isPartition]
    if slice_column and sliced_by != [slice_column.lower()]:
        raise ValueError(f"{table} is not partitioned by {slice_column!r}: its slices can't be replaced one by one")
    by_slice = slice_column is not None and mode == "append"
    before = spark.conf.get(OVERWRITE_MODE)
    spark.conf.set(OVERWRITE_MODE, "dynamic" if by_slice else "static")
    try:
        ordered = rows.select(*[F.col(f"`{n}`") for n in names])
        ordered.write.insertInto(table, overwrite=by_slice or mode == "overwrite")
    finally:
        spark.conf.set(OVERWRITE_MODE, before)


def write_validated(clean: DataFrame, path: str, fmt: str = "parquet", scattered: bool = False) -> None:
    """Clean rows, one folder per upload; writing an upload again replaces its folder.

    Rows in file order need no shuffle: a task holds whole stretches of few uploads. Rows
    `scattered` by a join are brought together per upload first, large uploads over
    several tasks.
    """
    rows = clean.hint("rebalance", F.col("upload_id")) if scattered else clean
    (
        rows.write.format(fmt)
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("upload_id")
        .save(path)
    )


def write_errors(errors: DataFrame, path: str, run_id: str) -> DataFrame:
    """Error rows of one run, ordered within files so that a reader of one upload skips
    most of them; writing a run again replaces it. Returns the rows as stored."""
    folder = f"{path.rstrip('/')}/run_id={run_id}"
    errors.sortWithinPartitions("upload_id", "row_number").write.mode("overwrite").parquet(folder)
    return errors.sparkSession.read.schema(errors.schema).parquet(folder)


def read_errors(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("run_id", F.col("run_id").cast("string"))
