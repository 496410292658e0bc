"""Records of text files, read by many tasks: one look at the text for cells, open quotes and
encoding, quoted line breaks across file splits, and the first byte that is not UTF-8.

Spark's text source cuts files at line feeds wherever they stand. Whether a line begins inside
a quoted cell follows from the lines before it: each line is a map from "outside" or "inside"
to one of the two, and maps compose. A split's map is that of its lines, a file's splits are
composed in order (one small row each), and then every line knows where it begins.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sluicegate.model import TemplateConfig
from sluicegate.sources.files import BLOCK, FILE, ORDINAL, RAGGED, SPLIT, plain_path
from sluicegate.sources.workspace import broadcast_if_small, materialise

OPEN_LINE = "_open_line"  # a line with a quoted cell that it does not close
GARBLED = "_garbled"  # the record's bytes are not valid in its encoding

# Encodings whose text can be cut at line feeds and decoded line by line.
LINE_ENCODINGS = ("UTF-8", "UTF8", "ISO-8859-1", "ISO8859-1", "LATIN1", "LATIN-1")


@dataclass(frozen=True)
class RecordScan:
    """`rows`: cells, `_ragged`, `_open_line`, `_garbled` and the coordinates of `scan_csv`;
    `unclosed`: files (path) that end inside a quoted cell and have no rows."""

    rows: DataFrame
    unclosed: DataFrame | None = None


def can_scan(cfg: TemplateConfig) -> bool:
    """Whether `scan_records` reads the template's files; others are left to `scan_csv`."""
    return cfg.encoding.upper() in LINE_ENCODINGS and len(cfg.delimiter) == 1


def _lines(
    spark: SparkSession, paths: str | Sequence[str], max_bytes: int | None, line_sep: str | None, **options: str
) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", True)
    if line_sep is not None:
        reader = reader.option("lineSep", line_sep)
    lines = reader.options(**options).text(list(paths) if not isinstance(paths, str) else paths)
    if max_bytes is not None:
        lines = lines.filter(F.col("_metadata.file_size") <= max_bytes)
    return lines.select(
        "value",
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias(BLOCK),
        F.col("_metadata.file_size").alias("_file_size"),
    )


def _decoded(cfg: TemplateConfig) -> tuple[Column, Column]:
    """A line's text, and whether its bytes are wrong."""
    if cfg.encoding.upper().startswith("UTF"):
        return F.col("value"), ~F.is_valid_utf8("value")
    return F.decode(F.col("value").cast("binary"), "ISO-8859-1"), F.lit(False)


def _cells(cfg: TemplateConfig, record: Column, options: dict[str, str]) -> Column:
    schema = T.StructType(
        [T.StructField(c.column_name, T.StringType()) for c in cfg.columns] + [T.StructField(RAGGED, T.StringType())]
    )
    how = {"sep": cfg.delimiter, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": RAGGED}
    how |= {"multiLine": "true"} if cfg.multi_line else {}
    ddl = ", ".join(f"`{f.name}` string" for f in schema)
    return F.from_csv(record, F.lit(ddl), how | {k: str(v) for k, v in options.items()})


def _quote_patterns(delimiter: str) -> tuple[str, str]:
    """Lines that end inside a quoted cell: those that begin outside, and those that begin inside."""
    sep = re.escape(delimiter)
    held = '(?:[^"]++|"")*+'
    cell = f'(?:"{held}"[^{sep}]*+|[^"{sep}][^{sep}]*+|)'
    tail = f'(?:{cell}{sep})*+"{held}$'
    return f"(?s)^{tail}", f'(?s)^{held}(?:$|"[^{sep}]*+{sep}{tail})'


def scan_records(
    spark: SparkSession,
    paths: str | Sequence[str],
    cfg: TemplateConfig,
    folder: str | None = None,
    max_bytes: int | None = None,
    **options: str,
) -> RecordScan:
    """The records of the template's files, from one read of their text.

    Without `multi_line` a record is a line; a line that opens a quoted cell and does not
    close it is also given in `_open_line`. With it, see `_assembled`, which stores the text
    in `folder` and starts jobs. `options` are those of the file source and of CSV cells.
    """
    files = {k: v for k, v in options.items() if k in ("pathGlobFilter", "modifiedBefore", "modifiedAfter")}
    parse = {k: v for k, v in options.items() if k not in files}
    record, wrong = _decoded(cfg)
    if cfg.multi_line:
        whole, unclosed = _assembled(_lines(spark, paths, max_bytes, "\n", **files), cfg, folder)
        rows = whole.select(_cells(cfg, F.col("record"), parse).alias("c"), F.lit(None).cast("string").alias(OPEN_LINE), GARBLED, FILE, BLOCK, ORDINAL)
    else:
        unclosed = None
        sep = re.escape(cfg.delimiter)
        cell = f'(?:\\s*+"(?:[^"]++|"")*+"[^{sep}]*+|\\s*+[^"{sep}][^{sep}]*+|\\s*+)'
        opens = f'^(?:{cell}{sep})*+\\s*+"(?:[^"]++|"")*+$'
        text = _lines(spark, paths, max_bytes, None, **files).filter(F.trim("value") != "")
        rows = text.select(
            _cells(cfg, record, parse).alias("c"),
            # Only lines with a quote are looked at closely.
            F.when(F.contains("value", F.lit('"')) & record.rlike(opens), record).alias(OPEN_LINE),
            wrong.alias(GARBLED),
            FILE,
            BLOCK,
            F.monotonically_increasing_id().alias(ORDINAL),
        )
    names = [*[c.column_name for c in cfg.columns], RAGGED]
    return RecordScan(rows.select(*[F.col(f"c.`{n}`").alias(n) for n in names], OPEN_LINE, GARBLED, FILE, BLOCK, ORDINAL), unclosed)


def _composed(const: Column, odd: Column, window, start: Column) -> Column:
    """State after the maps up to here: `const` is the state that a map ends in whatever it
    begins with (else NULL), and `odd` whether it turns over what it has then."""
    turns = F.sum(odd.cast("int")).over(window)
    # The turns that count are those after the last constant.
    anchor = F.last(F.when(const.isNotNull(), F.struct(const.alias("const"), F.col("_turns_before").alias("at"))), True).over(window)
    state = F.when(anchor.isNull(), start.cast("int") + turns).otherwise(anchor["const"].cast("int") + turns - anchor["at"])
    return F.pmod(state, F.lit(2)) == 1


def _assembled(lines: DataFrame, cfg: TemplateConfig, folder: str | None) -> tuple[DataFrame, DataFrame]:
    """Records of any number of lines (record, _garbled, file, block, ordinal), and the files
    that end inside a quoted cell (path), which have none.

    The lines are stored once. Two passes over their narrow columns, combined per task, give
    each split's map; then one shuffle brings the lines of a split together, where they are
    joined into records. What a split leaves open, and what it begins with, meets in a second,
    small one.
    """
    outside, inside = _quote_patterns(cfg.delimiter)
    text, wrong = _decoded(cfg)
    quoted = F.contains("value", F.lit('"'))
    body = lines.select(text.alias("value"), wrong.alias(GARBLED), FILE, BLOCK, F.monotonically_increasing_id().alias(ORDINAL))
    staged = materialise(
        body.withColumns(
            {
                SPLIT: F.xxhash64(FILE, BLOCK),
                "_from_outside": quoted & F.col("value").rlike(outside),
                "_from_inside": ~quoted | F.col("value").rlike(inside),
            }
        ),
        "lines",
        folder,
    )
    constant = F.col("_from_outside") == F.col("_from_inside")
    turn = F.col("_from_outside") & ~F.col("_from_inside")
    last = materialise(
        staged.groupBy(SPLIT, FILE, BLOCK).agg(F.max(F.when(constant, F.struct(ORDINAL, "_from_outside"))).alias("_last")),
        "last_constants",
        folder,
    )
    since = (
        staged.filter(turn)
        .select(SPLIT, FILE, BLOCK, ORDINAL)
        .join(broadcast_if_small(last), [SPLIT, FILE, BLOCK])
        .filter(F.col("_last").isNull() | (F.col(ORDINAL) > F.col(f"_last.{ORDINAL}")))
        .groupBy(SPLIT, FILE, BLOCK)
        .agg(F.count(F.lit(1)).alias("_turns"))
    )
    in_file = Window.partitionBy(FILE).orderBy(BLOCK)
    upto = in_file.rowsBetween(Window.unboundedPreceding, 0)
    maps = last.join(since, [SPLIT, FILE, BLOCK], "left").select(
        SPLIT, FILE, BLOCK, F.col("_last._from_outside").alias("_const"), (F.coalesce("_turns", F.lit(0)) % 2 == 1).alias("_odd")
    )
    # A constant map turns over its own state afterwards, so its anchor lies before its turns.
    counted = maps.withColumn("_turns_before", F.sum(F.col("_odd").cast("int")).over(upto) - F.col("_odd").cast("int"))
    ended = counted.withColumn("_end", _composed(F.col("_const"), F.col("_odd"), upto, F.lit(False)))
    splits = materialise(
        ended.select(
            SPLIT,
            FILE,
            BLOCK,
            F.coalesce(F.lag("_end").over(in_file), F.lit(False)).alias("_begin"),
            F.last("_end").over(in_file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_unclosed"),
        ),
        "line_splits",
        folder,
    )
    unclosed = splits.filter("_unclosed").select(plain_path(F.col(FILE)).alias("path")).distinct()

    by_line = Window.partitionBy(SPLIT, FILE, BLOCK).orderBy(ORDINAL)
    so_far = by_line.rowsBetween(Window.unboundedPreceding, 0)
    known = staged.join(broadcast_if_small(splits.filter(~F.col("_unclosed")).drop("_unclosed")), [SPLIT, FILE, BLOCK])
    known = known.withColumns({"_const": F.when(constant, F.col("_from_outside")), "_odd": turn})
    known = known.withColumn("_turns_before", F.sum(F.col("_odd").cast("int")).over(so_far))
    known = known.withColumn("_end", _composed(F.col("_const"), F.col("_odd"), so_far, F.col("_begin")))
    known = known.withColumn("_inside", F.coalesce(F.lag("_end").over(by_line), F.col("_begin")))
    starts = ~F.col("_inside") & ~F.col("value").isin("", "\r")
    known = known.withColumn("_starts", starts).filter(F.col("_inside") | F.col("_starts"))
    known = known.withColumn("_local", F.sum(F.col("_starts").cast("bigint")).over(so_far))

    def joined(order: str, value: str) -> Column:
        """The lines of one record, as many as it has."""
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), "\n")

    pieces = materialise(
        known.groupBy(SPLIT, FILE, BLOCK, "_local").agg(joined(ORDINAL, "value").alias("record"), F.max(GARBLED).alias(GARBLED)),
        "record_pieces",
        folder,
    )
    begun = pieces.groupBy(SPLIT, FILE, BLOCK).agg(F.max("_local").alias("_begun"))
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    homes = materialise(
        begun.withColumn("_home", F.last(F.when(F.col("_begun") > 0, F.struct(BLOCK, "_begun")), True).over(earlier)),
        "record_homes",
        folder,
    )
    placed = pieces.join(broadcast_if_small(homes), [SPLIT, FILE, BLOCK]).withColumns(
        {
            "_at": F.when(F.col("_local") > 0, F.col(BLOCK)).otherwise(F.col(f"_home.{BLOCK}")),
            "_number": F.when(F.col("_local") > 0, F.col("_local")).otherwise(F.col("_home._begun")),
        }
    )
    on_border = (F.col("_local") == 0) | (F.col("_local") == F.col("_begun"))
    across = placed.filter(on_border).groupBy(FILE, "_at", "_number").agg(joined(BLOCK, "record").alias("record"), F.max(GARBLED).alias(GARBLED))
    whole = placed.filter(~on_border).select(FILE, "_at", "_number", "record", GARBLED).unionByName(across)
    return (
        whole.select(
            F.regexp_replace("record", "\r$", "").alias("record"),
            GARBLED,
            FILE,
            F.col("_at").alias(BLOCK),
            (F.col("_number") - 1).alias(ORDINAL),
        ),
        unclosed,
    )


# Byte sequences that are UTF-8 (fixed values of the encoding), one character for each byte.
_VALID_UTF8 = (
    r"(?s)^(?:[\x00-\x7F]|[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}"
    r"|\xED[\x80-\x9F][\x80-\xBF]|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2})*+"
)
_BOM_BYTES = 3


def undecodable_files(
    spark: SparkSession, paths: str | Sequence[str], folder: str | None = None, **options: str
) -> DataFrame:
    """Files that are not valid UTF-8: path, length, first_bad_byte (counted from 0).

    No sequence holds a line feed, so every line is judged alone and a file by as many tasks
    as it has splits. Narrow columns (a length and, in bad lines, an offset) are stored; the
    text is read once and never moves. Starts a job.
    """
    lines = _lines(spark, paths, None, "\n", **options)
    as_bytes = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    good_prefix = F.length(F.regexp_extract(as_bytes, _VALID_UTF8, 0))
    narrow = materialise(
        lines.select(
            FILE,
            BLOCK,
            "_file_size",
            F.monotonically_increasing_id().alias(ORDINAL),
            (F.octet_length("value") + 1).cast("bigint").alias("_bytes"),
            F.when(~F.is_valid_utf8("value"), good_prefix).alias("_bad_at"),
        ),
        "line_lengths",
        folder,
    )
    bad = F.when(F.col("_bad_at").isNotNull(), F.struct(ORDINAL, "_bad_at"))
    per_split = materialise(
        narrow.groupBy(FILE, BLOCK, "_file_size").agg(F.sum("_bytes").alias("_bytes"), F.min(bad).alias("_bad")), "split_lengths", folder
    )
    in_file = Window.partitionBy(FILE).orderBy(BLOCK)
    everything = in_file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = (
        per_split.withColumns(
            {
                "_before": F.coalesce(F.sum("_bytes").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
                "_all": F.sum("_bytes").over(everything),
                "_first": F.min(F.when(F.col("_bad").isNotNull(), F.col(BLOCK))).over(everything),
            }
        )
        .filter(F.col(BLOCK) == F.col("_first"))
        .select(FILE, BLOCK, "_file_size", "_before", "_all", F.col(f"_bad.{ORDINAL}").alias("_line"), F.col("_bad._bad_at").alias("_offset"))
    )
    inside = (
        narrow.select(FILE, BLOCK, ORDINAL, "_bytes")
        .join(broadcast_if_small(materialise(first, "first_bad", folder)), [FILE, BLOCK])
        .groupBy(FILE, "_file_size", "_before", "_all", "_offset")
        .agg(F.sum(F.when(F.col(ORDINAL) < F.col("_line"), F.col("_bytes")).otherwise(0)).alias("_inside"))
    )
    # The reader passes over a byte order mark; lines and their ends then lack its bytes.
    mark = F.when(F.col("_file_size") - F.col("_all") >= _BOM_BYTES - 1, _BOM_BYTES).otherwise(0)
    return inside.select(
        plain_path(F.col(FILE)).alias("path"),
        F.col("_file_size").alias("length"),
        (F.col("_before") + F.col("_inside") + F.col("_offset") + mark).cast("bigint").alias("first_bad_byte"),
    )
