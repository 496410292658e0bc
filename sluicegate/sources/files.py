"""File scans: template CSV, source row numbers, header records, inventory."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sluicegate.model import TemplateConfig
from sluicegate.sources.workspace import broadcast_if_small, materialise

RAGGED = "_ragged"  # raw text of a record whose field count differs from the template
FILE = "_file"
FILE_NAME = "_file_name"
BLOCK = "_block"
ORDINAL = "_ordinal"
SPLIT = "_split"
UPLOAD_ID = "element_at(split(path, '/'), -1)"  # the file name

# Encodings whose line feed is wider than one byte cannot be split at line ends.
_WIDE_ENCODINGS = ("UTF-16", "UTF-32")


def scan_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    cfg: TemplateConfig,
    max_bytes: int | None = None,
    **options: str,
) -> DataFrame:
    """Read files as the template describes them: every cell a STRING, records of a
    different width kept whole in `_ragged`, and the coordinates that `with_row_numbers`
    needs. The header record is row 0 of its file, so one scan serves the header check
    and the data.

    Reading continues with `with_row_numbers` (which drops nothing) and
    `data_rows` / `header_rows`. Files above `max_bytes` are left out when the scan is
    planned; they are not opened.
    """
    if cfg.file_format != "csv":
        raise ValueError(f"only csv files can be scanned, not {cfg.file_format!r}; convert them first")
    schema = T.StructType(
        [T.StructField(c.column_name, T.StringType()) for c in cfg.columns] + [T.StructField(RAGGED, T.StringType())]
    )
    reader = (
        spark.read.schema(schema)
        .option("sep", cfg.delimiter)
        .option("encoding", cfg.encoding)
        .option("header", False)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", RAGGED)
        .option("escape", '"')
        .option("multiLine", cfg.multi_line or cfg.encoding.upper().startswith(_WIDE_ENCODINGS))
        .option("recursiveFileLookup", True)
    )
    scan = reader.options(**options).csv(list(paths) if not isinstance(paths, str) else paths)
    if max_bytes is not None:
        scan = scan.filter(F.col("_metadata.file_size") <= max_bytes)
    return scan.select(
        *[F.col(f"`{n}`") for n in schema.names],
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias(BLOCK),
        F.monotonically_increasing_id().alias(ORDINAL),
    )


def plain_path(uri: Column) -> Column:
    """The path a file listing shows; scans report it with percent escapes."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


@dataclass(frozen=True)
class NumberedScan:
    """`rows`: the records with `row_number`, their file and its upload; `splits`: one row
    per file split with its record count, so that counting needs no second look at rows;
    `staged`: the scan as it was stored."""

    rows: DataFrame
    splits: DataFrame
    staged: DataFrame


def number_records(
    scan: DataFrame,
    header: bool = True,
    folder: str | None = None,
    upload_id: str = UPLOAD_ID,
    source_file: str = UPLOAD_ID,
) -> NumberedScan:
    """Number the records of each file: 0 is the header, data starts at 1 (files without
    header start at 1 too). `upload_id` and `source_file`, the name that rows carry, are SQL
    expressions over `path`.

    The scan is written to the shared folder first: record ordinals are only comparable
    within one execution of a scan, and all later steps then read compressed columns
    instead of parsing the text again. What depends on the file alone is computed once per
    split and joined by a number. Both tables are put into `folder` if one is given.
    """
    staged = materialise(scan.withColumn(SPLIT, F.xxhash64(FILE, BLOCK)), "scan", folder)
    per_split = staged.groupBy(SPLIT, FILE, BLOCK).agg(
        F.min(ORDINAL).alias("_first"), F.count(F.lit(1)).alias("records")
    )
    before = Window.partitionBy(FILE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    start = 0 if header else 1
    splits = materialise(
        per_split.select(
            SPLIT,
            FILE,
            BLOCK,
            "records",
            (F.coalesce(F.sum("records").over(before), F.lit(0)) - F.col("_first") + F.lit(start)).alias("_shift"),
        )
        .withColumn("path", plain_path(F.col(FILE)))
        .withColumns({FILE_NAME: F.expr(source_file), "upload_id": F.expr(upload_id)})
        .drop("path"),
        "splits",
        folder,
    )
    # Two splits with the same number are next to impossible, and then the names decide.
    clash = not splits.groupBy(SPLIT).count().filter("count > 1").isEmpty()
    if clash:
        rows = staged.join(broadcast_if_small(splits.drop("records")), [SPLIT, FILE, BLOCK])
    else:
        # Splits carry numbers only, so that even very many of them can be broadcast; names
        # come with the file, of which there are fewer.
        numbers = splits.select(SPLIT, BLOCK, "_shift", F.xxhash64(FILE).alias("_number"))
        named = splits.filter(F.col(BLOCK) == 0).select(F.xxhash64(FILE).alias("_number"), FILE, FILE_NAME, "upload_id")
        rows = (
            staged.drop(FILE, BLOCK)
            .join(broadcast_if_small(numbers), SPLIT)
            .join(broadcast_if_small(named), "_number")
            .drop("_number")
        )
    rows = rows.withColumn("row_number", F.col(ORDINAL) + F.col("_shift")).drop("_shift", SPLIT)
    return NumberedScan(rows, splits, staged)


def with_row_numbers(scan: DataFrame, header: bool = True, folder: str | None = None) -> DataFrame:
    """The numbered records alone, see `number_records`."""
    return number_records(scan, header, folder).rows


def record_counts(splits: DataFrame, header: bool = True) -> DataFrame:
    """Data records per upload: (upload_id, total_rows)."""
    first = F.col(BLOCK) == 0
    headers = F.count_if(first) if header else F.lit(0)
    return splits.groupBy("upload_id").agg((F.sum("records") - headers).alias("total_rows"))


def data_rows(numbered: DataFrame) -> DataFrame:
    return numbered.filter(F.col("row_number") > 0)


def header_rows(numbered: DataFrame, cfg: TemplateConfig) -> DataFrame:
    """One row per file with its header as an array: (file, upload, header)."""
    cells = F.array(*[F.col(f"`{c.column_name}`") for c in cfg.columns])
    # A header of another width was kept as raw text; names hold no delimiters.
    split = F.transform(
        F.split(F.col(RAGGED), "\\Q" + cfg.delimiter + "\\E", -1),
        lambda name: F.regexp_replace(name, '^"(.*)"$', "$1"),
    )
    header = F.when(F.col(RAGGED).isNull(), cells).otherwise(split)
    # Joined to first splits only: the other rows fall out at the broadcast join.
    return numbered.filter((F.col(BLOCK) == 0) & (F.col("row_number") == 0)).select(
        *[c for c in (FILE, FILE_NAME, "upload_id") if c in numbered.columns],
        F.transform(header, lambda name: F.trim(F.regexp_replace(name, "^\\x{feff}", ""))).alias("header"),
    )


def literal_path(path: str) -> str:
    """A path for the readers that stands for itself, whatever pattern characters it has."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def path_below(spark: SparkSession, *roots: str) -> str:
    """SQL expression over `path`: what follows the root that a file lies below. Files of
    one name in several folders differ. For roots with pattern characters, and those that
    are files themselves, it is the whole path."""
    found = "path"
    for root in sorted(roots, key=len):
        if re.search(r"[*?\[\]{}]", re.sub(r"\\.", "", root)):
            continue
        plain = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(re.sub(r"\\(.)", r"\1", root))
        base = plain.toUri().getPath().rstrip("/") + "/"
        literal = "'" + base.replace("\\", "\\\\").replace("'", "\\'") + "'"
        found = f"if(instr(path, {literal}) > 0, substring(path, instr(path, {literal}) + length({literal})), {found})"
    return found


def open_quotes(
    scan: DataFrame, cfg: TemplateConfig, paths: str | Sequence[str], folder: str | None = None, **options: str
) -> DataFrame:
    """Lines that open a quoted cell and don't close it: (path, line). A template that is
    not `multi_line` can't hold what follows, and reading on would make up records.

    For encodings that `records.scan_records` does not read. `scan` is a staged scan of the
    same files. Such a line leaves a cell that begins with a quote, or a record of another
    width; only files that have one are looked at again.
    """
    spark = scan.sparkSession
    odd = [F.col(f"`{c.column_name}`").startswith('"') for c in cfg.columns]
    odd.append(F.contains(F.col(RAGGED), F.lit('"')))
    suspects = scan.filter(reduce(lambda a, b: a | b, [F.coalesce(o, F.lit(False)) for o in odd]))
    suspects = materialise(suspects.select(plain_path(F.col(FILE)).alias("path")).distinct(), "suspects", folder)
    sep = re.escape(cfg.delimiter)
    cell = f'(?:\\s*+"(?:[^"]++|"")*+"[^{sep}]*+|\\s*+[^"{sep}][^{sep}]*+|\\s*+)'
    unclosed = f'^(?:{cell}{sep})*+\\s*+"(?:[^"]++|"")*+$'
    lines = (
        spark.read.option("recursiveFileLookup", True)
        .options(**options)
        .text(list(paths) if not isinstance(paths, str) else paths)
        .select(plain_path(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("line"))
    )
    return lines.join(broadcast_if_small(suspects), "path", "left_semi").filter(F.col("line").rlike(unclosed))


def list_files(spark: SparkSession, folder: str | Sequence[str], pattern: str | None = None) -> DataFrame:
    """Files below a folder: path, name, length, modificationTime. Contents are not read.
    Spark's file sources pass over files of length 0; `empty_files` finds those."""
    return _described(_listing(spark, folder, pattern))


def _listing(spark: SparkSession, folder: str | Sequence[str], pattern: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder if isinstance(folder, str) else list(folder))


def _described(files: DataFrame) -> DataFrame:
    return files.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "modificationTime"
    )


def empty_files(spark: SparkSession, folder: str | Sequence[str]) -> DataFrame:
    """Files of length 0 below a folder, in the form of `list_files`, without a time. They are
    the files of Spark's own listing, which many tasks make where there are many folders,
    that no scan shows; the driver holds names only, as it does for every scan."""
    return _without_rows(_listing(spark, folder))


def _without_rows(files: DataFrame) -> DataFrame:
    names = files.sparkSession.createDataFrame(pd.DataFrame({FILE: files.inputFiles()}, dtype=object), f"{FILE} string")
    listed = names.select(F.regexp_replace(plain_path(F.col(FILE)), "^file:/+", "file:/").alias("path"))
    return listed.join(files.select("path"), "path", "left_anti").select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.lit(0).cast("bigint").alias("length"),
        F.lit(None).cast("timestamp").alias("modificationTime"),
    )


def every_file(spark: SparkSession, folder: str | Sequence[str]) -> DataFrame:
    """`list_files` and `empty_files` in one, from a single listing."""
    files = _listing(spark, folder)
    return _described(files).unionByName(_without_rows(files))


def existing_files(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """`wanted` (path) with a flag telling whether each file exists below the folder."""
    there = list_files(spark, folder).select("path", F.lit(True).alias("_there"))
    return wanted.join(there, "path", "left").select(
        *wanted.columns, F.coalesce("_there", F.lit(False)).alias("file_exists")
    )
