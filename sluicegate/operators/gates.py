"""Cheap gates before any cell is read, header check, type inference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicegate.functions.cells import castable, is_blank
from sluicegate.model import FILE_FORMATS, MAX_UPLOAD_BYTES, spark_type

# Narrowest first.
INFERENCE_ORDER = ("INTEGER", "BIGINT", "DOUBLE", "BOOLEAN", "DATE", "TIMESTAMP")


def upload_gates(
    files: DataFrame, max_bytes: int = MAX_UPLOAD_BYTES, extensions: Sequence[str] = FILE_FORMATS
) -> DataFrame:
    """Add `gate` to a file listing (path, length): ok, too_large or wrong_extension."""
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.withColumn(
        "gate",
        F.when(~extension.isin(*extensions), "wrong_extension")
        .when(F.col("length") > max_bytes, "too_large")
        .otherwise("ok"),
    )


def expected_headers(columns: DataFrame) -> DataFrame:
    """Ordered column names per template, excluded columns too: (template_id, expected).
    A list is as long as its table is wide."""
    return (
        columns.groupBy("template_id")
        .agg(F.sort_array(F.collect_list(F.struct("column_order", "column_name"))).alias("c"))
        .select("template_id", F.col("c.column_name").alias("expected"))
    )


def check_headers(headers: DataFrame, columns: DataFrame) -> DataFrame:
    """Compare headers of many files with their templates.

    `headers`: upload_id, template_id, header (array); `columns`: template_columns rows.
    Returns expected and actual counts, the missing, extra, misplaced and repeated names
    as arrays, and `header_ok`.
    """
    both = headers.join(expected_headers(columns), "template_id")
    header, expected = F.col("header"), F.col("expected")
    shared = F.array_intersect(expected, header)
    misplaced = F.filter(shared, lambda n: F.array_position(expected, n) != F.array_position(header, n))
    repeated = F.filter(
        F.array_distinct(header), lambda n: F.size(F.filter(header, lambda other: other == n)) > 1
    )
    return both.select(
        "upload_id",
        "template_id",
        F.size(expected).alias("expected_columns"),
        F.size(header).alias("actual_columns"),
        F.array_except(expected, header).alias("missing"),
        F.array_except(header, expected).alias("extra"),
        misplaced.alias("misplaced"),
        repeated.alias("repeated"),
        (header == expected).alias("header_ok"),
    )


def header_errors(checked: DataFrame) -> DataFrame:
    """SCHEMA_MISMATCH rows (row 0) of the failed headers of `check_headers`."""
    problems = [
        ("missing", "Column is missing from the header"),
        ("extra", "Column is not part of the template"),
        ("misplaced", "Column is at another position"),
        ("repeated", "Column occurs more than once"),
    ]

    def described(text: str):
        return lambda name: F.struct(name.alias("column_name"), F.lit(text).alias("error_message"))

    found = [F.transform(F.col(field), described(text)) for field, text in problems]
    return (
        checked.filter(~F.col("header_ok"))
        .select("upload_id", F.explode(F.concat(*found)).alias("e"))
        .select(
            "upload_id",
            F.lit(0).cast("bigint").alias("row_number"),
            "e.column_name",
            F.lit("SCHEMA_MISMATCH").alias("error_type"),
            "e.error_message",
            F.lit(None).cast("string").alias("raw_value"),
        )
    )


def _reads_as(value: Column, kind: str) -> Column:
    """Whether a sample value suggests the type, by the test that validation makes."""
    return castable(value, spark_type(kind))


_PLAIN_DECIMAL = r"^[+-]?(\d+)(?:\.(\d*))?$"
MAX_DIGITS = 38


def infer_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Narrowest type of each column of an all-STRING sample:
    (position, column_name, data_type, non_blank, blank). One pass, one aggregate row."""
    names = list(columns or df.columns)
    counts = []
    for i, name in enumerate(names):
        v = F.col(f"`{name}`")
        filled = ~is_blank(v)
        counts.append(F.count_if(filled).alias(f"filled_{i}"))
        counts.append(F.count_if(~filled).alias(f"blank_{i}"))
        counts += [F.count_if(filled & ~_reads_as(v, kind)).alias(f"bad_{i}_{kind}") for kind in INFERENCE_ORDER]
        number = F.trim(v)
        counts.append(F.count_if(filled & ~number.rlike(_PLAIN_DECIMAL)).alias(f"bad_{i}_DECIMAL"))
        counts += [
            F.max(F.when(filled, F.length(F.regexp_extract(number, _PLAIN_DECIMAL, group)))).alias(f"{part}_{i}")
            for group, part in ((1, "whole"), (2, "scale"))
        ]
    profiles = []
    for i, name in enumerate(names):
        narrowest = F.when(F.col(f"filled_{i}") == 0, "STRING")
        for kind in INFERENCE_ORDER:
            if kind == "DOUBLE":
                # Plain numbers with decimals keep all their digits.
                whole, scale = F.col(f"whole_{i}"), F.col(f"scale_{i}")
                narrowest = narrowest.when(
                    (F.col(f"bad_{i}_DECIMAL") == 0) & (whole + scale <= MAX_DIGITS),
                    F.format_string("DECIMAL(%d,%d)", whole + scale, scale),
                )
            narrowest = narrowest.when(F.col(f"bad_{i}_{kind}") == 0, kind)
        profiles.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(name).alias("column_name"),
                narrowest.otherwise("STRING").alias("data_type"),
                F.col(f"filled_{i}").alias("non_blank"),
                F.col(f"blank_{i}").alias("blank"),
            )
        )
    return df.agg(*counts).select(F.inline(F.array(*profiles)))
