"""Registered queries that read files: the given tables are written as uploads first."""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixtures import table, view, with_views
from checks.validation import CLEAN_SQL, ERRORS_SQL, NAMES, ORDERS, VERDICT_SQL, _clean, _errors, report
from sluicegate.functions.paths import parse_stored_path, stored_path
from sluicegate.model import ColumnConfig, TemplateConfig
from sluicegate.operators.gates import check_headers
from sluicegate.operators.provision import provision
from sluicegate.operators.publish import with_audit_columns
from sluicegate.operators.validate import ragged_errors
from sluicegate.operators.history import current_uploads
from sluicegate.plans.ingest import IngestContext, ingest
from sluicegate.sources import files, sinks
from sluicegate.sources.records import undecodable_files
from sluicegate.sources.workspace import materialise, new_folder
from sluicegate.streaming.ingest import BATCH, ingest_stream

UPLOAD_OF_PATH = "cast(regexp_extract(path, 'upload_id=([0-9]+)', 1) as bigint)"
INGESTED = dataclasses.replace(ORDERS, bad_row_threshold="8.00", bad_row_action="drop", write_mode="append")
RAGGED = TemplateConfig(
    columns=tuple(ColumnConfig(n, column_order=i) for i, n in enumerate(("key", "status", "priority"))),
    template_id="ragged",
)

_written: dict[tuple[str, str, str], str] = {}


def _once(spark: SparkSession, sf: str, label: str, write) -> str:
    """Folder of a file fixture, written once per session and scale."""
    key = (spark.sparkContext.applicationId, sf, label)
    if key not in _written:
        folder = new_folder(spark, label)
        write(folder)
        _written[key] = folder
    return _written[key]


def order_files(spark: SparkSession, sf: str) -> str:
    """filed_orders as CSV with header, one file per upload, rows in order."""

    def write(folder: str) -> None:
        rows = view(spark, sf, "filed_orders").repartition("upload_id")
        ordered = rows.sortWithinPartitions("upload_id", "order_number").select("upload_id", *NAMES)
        ordered.write.partitionBy("upload_id").option("header", True).csv(folder)

    return _once(spark, sf, "order_files", write)


def ragged_files(spark: SparkSession, sf: str) -> str:
    """One line per order with two to four fields, in files of bounded length that start
    with a header line."""

    def write(folder: str) -> None:
        key = F.col("o_orderkey")
        upload = (key / 1_000_000).cast("bigint").alias("upload_id")
        fields = F.array(key.cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority"), F.lit("surplus"))
        width = F.when(key % 7 == 3, 2).when(key % 11 == 4, 4).otherwise(3)
        orders = table(spark, sf, "orders")
        lines = orders.select(upload, key.alias("at"), F.array_join(F.slice(fields, 1, width), ",").alias("line"))
        headers = lines.select("upload_id").distinct().select(
            "upload_id", F.lit(-1).cast("bigint").alias("at"), F.lit("key,status,priority").alias("line")
        )
        every = lines.unionByName(headers).repartition("upload_id")
        every.sortWithinPartitions("upload_id", "at").select("upload_id", "line").write.partitionBy("upload_id").text(
            folder
        )

    return _once(spark, sf, "ragged_files", write)


def _numbered(spark: SparkSession, folder: str, cfg: TemplateConfig) -> DataFrame:
    return files.number_records(files.scan_csv(spark, folder, cfg), upload_id=UPLOAD_OF_PATH).rows


def scanned_orders(spark, sf):
    """The scan without numbering; the header record of each file is recognised by its text."""
    scan = files.scan_csv(spark, order_files(spark, sf), ORDERS)
    return scan.filter("order_code <> 'order_code'").select(
        F.expr(UPLOAD_OF_PATH.replace("path", files.FILE)).alias("upload_id"), *NAMES
    )


def source_row_numbers(spark, sf):
    numbered = _numbered(spark, order_files(spark, sf), ORDERS)
    return files.data_rows(numbered).select("upload_id", "row_number", *NAMES)


def scanned_headers(spark, sf):
    numbered = _numbered(spark, order_files(spark, sf), ORDERS)
    headers = files.header_rows(numbered, ORDERS).select("upload_id", F.lit("orders").alias("template_id"), "header")
    columns = spark.createDataFrame(
        [("orders", c.column_name, c.column_order) for c in ORDERS.columns],
        "template_id string, column_name string, column_order int",
    )
    return check_headers(headers, columns).select("upload_id", "expected_columns", "actual_columns", "header_ok")


def ragged_records(spark, sf):
    rows = files.data_rows(_numbered(spark, ragged_files(spark, sf), RAGGED))
    return ragged_errors(rows, RAGGED)


def file_inventory(spark, sf):
    listed = files.list_files(spark, order_files(spark, sf), "*.csv")
    return listed.select(F.expr(UPLOAD_OF_PATH).alias("upload_id"), (F.col("length") > 0).alias("has_content"))


def stored_paths(spark, sf):
    orders = table(spark, sf, "orders")
    path = stored_path(
        F.lit("landing"),
        F.lower(F.regexp_replace("o_orderpriority", "[^A-Za-z0-9]+", "_")),
        F.concat(F.lit("t_"), F.col("o_custkey").cast("string")),
        "o_orderdate",
        F.when(F.col("o_orderkey") % 2 == 0, "csv").otherwise("xlsx"),
    )
    return orders.select("o_orderkey", path.alias("path"))


def parsed_paths(spark, sf):
    parsed = stored_paths(spark, sf).select("o_orderkey", parse_stored_path("path").alias("p"))
    return parsed.select(
        "o_orderkey",
        "p.container",
        "p.domain",
        "p.template",
        F.date_format("p.received_at", "yyyy-MM-dd HH:mm:ss").alias("received_at"),
        "p.extension",
    )


def _audited(spark, sf):
    stored = F.concat(F.lit("orders_"), F.col("upload_id").cast("string"), F.lit(".csv"))
    return with_audit_columns(_clean(spark, sf), "s1@x.test", "2024-02-01 00:00:00", stored)


def _read_target(spark, path):
    return spark.read.parquet(path).drop("uploaded_at")


def appended_target(spark, sf):
    """Two appends: uploads of odd months, then of even ones."""
    path = new_folder(spark, "target")
    rows = _audited(spark, sf)
    sinks.write_target(rows.filter("upload_id % 2 = 1"), ORDERS, "append", path)
    sinks.write_target(rows.filter("upload_id % 2 = 0"), ORDERS, "append", path)
    return _read_target(spark, path)


def overwritten_target(spark, sf):
    """Everything, then overwritten by a selection of the target itself."""
    path = new_folder(spark, "target")
    sinks.write_target(_audited(spark, sf), ORDERS, "overwrite", path)
    sinks.write_target(spark.read.parquet(path).filter("amount > 200000"), ORDERS, "overwrite", path)
    return _read_target(spark, path)


def validated_files(spark, sf):
    path = new_folder(spark, "validated")
    clean = _clean(spark, sf)
    sinks.write_validated(clean, path)
    return spark.read.schema(clean.schema).parquet(path)


def stored_errors(spark, sf):
    path = new_folder(spark, "errors")
    sinks.write_errors(_errors(spark, sf), path, "r1")
    return sinks.read_errors(spark, path)


def _context(spark: SparkSession) -> IngestContext:
    base = new_folder(spark, "ingest")
    return IngestContext(
        uploaded_by="s1@x.test",
        uploaded_at="2024-02-01 00:00:00",
        errors_path=f"{base}/errors",
        history_path=f"{base}/history",
        target_path=f"{base}/target",
        upload_id=UPLOAD_OF_PATH,
        run_id="r1",
    )


def ingested_rows(spark, sf):
    ctx = _context(spark)
    ingest(spark, order_files(spark, sf), INGESTED, ctx)
    return spark.read.parquet(ctx.target_path).select(*NAMES, "uploaded_by")


def ingested_verdicts(spark, sf):
    ctx = _context(spark)
    return ingest(spark, order_files(spark, sf), INGESTED, ctx).verdicts


def ingested_errors(spark, sf):
    ctx = _context(spark)
    return ingest(spark, order_files(spark, sf), INGESTED, ctx).errors


def streamed_rows(spark, sf):
    ctx = _context(spark)
    query = ingest_stream(spark, order_files(spark, sf), INGESTED, ctx, new_folder(spark, "checkpoint"))
    query.awaitTermination()
    return spark.read.parquet(ctx.target_path).select(*NAMES, "uploaded_by")


def _with_an_empty_file(spark: SparkSession, sf: str, folder: str) -> None:
    """The orders files and, as upload 0, a file without a byte."""
    rows = view(spark, sf, "filed_orders").repartition("upload_id").sortWithinPartitions("upload_id", "order_number")
    rows.select("upload_id", *NAMES).write.partitionBy("upload_id").option("header", True).csv(folder)
    rows.select(*NAMES).filter("false").coalesce(1).write.csv(f"{folder}/upload_id=0")


def streamed_outcomes(spark, sf):
    """The last status of every file of a stream, one of which is empty."""
    ctx = _context(spark)
    folder = _once(spark, sf, "order_files_and_empty", lambda f: _with_an_empty_file(spark, sf, f))
    ingest_stream(spark, folder, INGESTED, ctx, new_folder(spark, "checkpoint")).awaitTermination()
    return current_uploads(spark.read.parquet(ctx.history_path)).select("upload_id", "status")


def bad_bytes(spark, sf):
    """Documents as lines of bounded files, some with a byte that UTF-8 does not have: where the
    first one of each file lies."""

    def write(folder: str) -> None:
        line = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" "))
        docs = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 500).alias("part"), "doc_id", line.alias("line"))
        broken = F.expr("concat(substring(line, 1, 7), cast(x'FF' as string), substring(line, 8))")
        lines = docs.withColumn("line", F.when(F.col("doc_id") % 97 == 5, broken).otherwise(F.col("line")))
        ordered = lines.repartition("part").sortWithinPartitions("part", "doc_id")
        ordered.select("part", "line").write.partitionBy("part").text(folder)

    found = undecodable_files(spark, _once(spark, sf, "document_lines", write))
    part = F.regexp_extract("path", "part=([0-9]+)", 1).cast("bigint").alias("part")
    return found.select(part, "length", "first_bad_byte")


def _by_parts(spark: SparkSession, sf: str, folder: str, parts: int) -> list[str]:
    """The uploads of the orders files dealt over folders of their own, month by month, as
    links would do."""
    month = F.floor(F.col("upload_id") / 1000)
    rows = view(spark, sf, "filed_orders").select("*", (month % parts).alias("part"))
    ordered = rows.repartition("upload_id").sortWithinPartitions("part", "upload_id", "order_number")
    ordered.select("part", "upload_id", *NAMES).write.partitionBy("part", "upload_id").option("header", True).csv(folder)
    return [f"{folder}/part={i}" for i in range(parts)]


def streamed_table_rows(spark, sf):
    """Two streams one after the other into one provisioned table: their slices add up."""
    parts = _by_parts(spark, sf, new_folder(spark, "landing"), 2)
    name = f"streamed_{uuid.uuid4().hex}"
    cfg = dataclasses.replace(INGESTED, fully_qualified_name=name)
    provision(spark, [cfg], slice_column=BATCH)
    ctx = dataclasses.replace(_context(spark), target_path=None, target_table=name)
    for folder in parts:
        ingest_stream(spark, folder, cfg, ctx, new_folder(spark, "checkpoint")).awaitTermination()
    return _taken(spark, name).select(*NAMES, "uploaded_by")


def overwritten_table(spark, sf):
    """A provisioned table, filled, then overwritten by a selection of itself; with the
    number of column comments that are still there."""
    name = f"overwritten_{uuid.uuid4().hex}"
    cfg = dataclasses.replace(ORDERS, fully_qualified_name=name)
    provision(spark, [cfg])
    sinks.write_target(_audited(spark, sf), cfg, "overwrite", table=name)
    sinks.write_target(spark.table(name).filter("amount > 200000"), cfg, "overwrite", table=name)
    comments = sum(1 for c in spark.catalog.listColumns(name) if c.description)
    return _taken(spark, name).drop("uploaded_at").withColumn("comments", F.lit(comments))


def _taken(spark: SparkSession, name: str) -> DataFrame:
    """The rows of a table made for one query, which is dropped."""
    rows = materialise(spark.table(name), "taken")
    spark.sql(f"drop table {name}")
    return rows


def nested_uploads(spark, sf):
    """Files in many folders, all of them named by their partition only, told apart by their
    path below the landing folder."""
    verdicts = ingest(spark, order_files(spark, sf), INGESTED, dataclasses.replace(_context(spark), upload_id=None)).verdicts
    return verdicts.select(F.regexp_replace("upload_id", "/[^/]*$", "").alias("folder"), "total_rows")


TEXTS = TemplateConfig(
    columns=(
        ColumnConfig("doc_id", "BIGINT", is_nullable=False, column_order=0),
        ColumnConfig("text", "STRING", column_order=1),
        ColumnConfig("lang", "STRING", column_order=2),
    ),
    template_id="texts",
    bad_row_threshold="0.00",
    multi_line=True,
)


def _bounded(rows, max_bytes: int):
    """Rows dealt over as many files as keep each well below the limit of an upload."""
    bytes_of = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 3 for c in rows.columns]
    size = rows.agg(F.sum(sum(bytes_of).cast("bigint"))).first()[0] or 0
    return rows.repartition(max(size * 4 // max_bytes + 1, rows.sparkSession.sparkContext.defaultParallelism))


def multi_line_texts(spark, sf):
    """Documents, line breaks and all, as quoted CSV cells, ingested and read back."""
    folder = new_folder(spark, "landing")
    ctx = dataclasses.replace(_context(spark), upload_id=None)
    texts = _bounded(table(spark, sf, "documents").select("doc_id", "text", "lang"), ctx.max_bytes)
    texts.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(folder)
    ingest(spark, folder, TEXTS, ctx)
    return spark.read.parquet(ctx.target_path).select("doc_id", F.trim("text").alias("text"), "lang")


def ingested_history(spark, sf):
    """The events of a run: status by status, with their counts."""
    ctx = _context(spark)
    ingest(spark, order_files(spark, sf), INGESTED, ctx)
    events = spark.read.parquet(ctx.history_path)
    return events.select("upload_id", "event_id", "status", "total_rows", "valid_rows", "dropped_rows", "written_rows")


def ingested_log(spark, sf):
    """The stored log of a run's expectations, one of which drops rows."""
    ctx = dataclasses.replace(_context(spark), checks={"amount_limit": "amount < 400000"})
    ingest(spark, order_files(spark, sf), INGESTED, ctx)
    return spark.read.parquet(f"{ctx.history_path}_expectations").select("rule", "processed", "passed", "dropped")


_NUMBERED = """
numbered as (select upload_id, 'orders' as template_id, row_number() over (partition by upload_id order by order_number)
    as row_number, order_code, nullif(cust_code, '') as cust_code, amount, order_date, note from filed_orders),
raw_orders_templates as (select 'orders' as template_id, cast(8 as decimal(5,2)) as bad_row_threshold,
    'drop' as bad_row_action)"""


def _over_files(last: str) -> str:
    parts = {"errors": ERRORS_SQL, "verdicts": VERDICT_SQL, "clean": CLEAN_SQL}
    ctes = "".join(f",\n{name} as ({sql.replace('{rows}', 'numbered')})" for name, sql in parts.items())
    return with_views("filed_orders", "").rstrip() + "," + _NUMBERED + ctes + "\n" + last


_TARGET = "order_code, cust_code, amount, order_date, note"
_STORED_PATH = """select o_orderkey, 'landing/' || lower(regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', '_', 'g'))
  || '/t_' || o_custkey || '/t_' || o_custkey || '_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') || '.'
  || case when o_orderkey % 2 = 0 then 'csv' else 'xlsx' end as path from orders"""

_EVENTS_SQL = """
select upload_id, cast(0 as bigint) as event_id, 'file_uploaded' as status, null::bigint as total_rows,
  null::bigint as valid_rows, null::bigint as dropped_rows, null::bigint as written_rows from verdicts
union all
select upload_id, i, s, total_rows, valid_rows, dropped_rows, case when outcome = 'failed' then 0 else valid_rows end
from verdicts, lateral (values (1::bigint, 'schema_validated'), (2, 'constraints_checked'),
  (3, case when outcome = 'failed' then 'failed' else 'writing_to_catalog' end),
  (4, case when outcome <> 'failed' then outcome end)) as e(i, s) where s is not null"""
_LOG_SQL = """
select rule, (select count(*) from clean) as processed, (select count(*) from clean) - dropped as passed, dropped
from (select unnest(['order_code_not_null', 'cust_code_not_null', 'amount_not_null', 'order_date_not_null',
    'amount_limit']) as rule,
  unnest([0, 0, 0, 0, (select count(*) from clean where not coalesce(amount < 400000, false))])::bigint as dropped)"""

QUERIES = {
    "csv_scan": (
        scanned_orders,
        with_views(
            "filed_orders",
            "select upload_id, order_code, nullif(cust_code, '') as cust_code, amount, order_date, note from filed_orders",
        ),
    ),
    "source_row_numbers": (
        source_row_numbers,
        _over_files(f"select upload_id, row_number, {_TARGET} from numbered"),
    ),
    "scanned_headers": (
        scanned_headers,
        with_views(
            "filed_orders",
            "select distinct upload_id, 5 as expected_columns, 5 as actual_columns, true as header_ok from filed_orders",
        ),
    ),
    "ragged_records": (
        ragged_records,
        """select * from (select cast(floor(o_orderkey / 1000000) as bigint) as upload_id,
    row_number() over (partition by floor(o_orderkey / 1000000) order by o_orderkey) as row_number,
    '_row' as column_name, 'SCHEMA_MISMATCH' as error_type, 'Record does not have 3 fields' as error_message,
    case when o_orderkey % 7 = 3 then o_orderkey || ',' || o_orderstatus
      else o_orderkey || ',' || o_orderstatus || ',' || o_orderpriority
        || case when o_orderkey % 11 = 4 then ',surplus' else '' end end as raw_value from orders) as x
where length(raw_value) - length(replace(raw_value, ',', '')) <> 2""",
    ),
    "file_inventory": (
        file_inventory,
        with_views("filed_orders", "select distinct upload_id, true as has_content from filed_orders"),
    ),
    "stored_paths": (stored_paths, _STORED_PATH),
    "parsed_paths": (
        parsed_paths,
        "select o_orderkey, 'landing' as container, "
        "lower(regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', '_', 'g')) as domain, 't_' || o_custkey as template, "
        "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as received_at, "
        "case when o_orderkey % 2 = 0 then 'csv' else 'xlsx' end as extension from orders",
    ),
    "appended_target": (
        appended_target,
        report(
            f"select {_TARGET}, 's1@x.test' as uploaded_by, 'orders_' || upload_id || '.csv' as source_file from clean"
        ),
    ),
    "overwritten_target": (
        overwritten_target,
        report(
            f"select {_TARGET}, 's1@x.test' as uploaded_by, 'orders_' || upload_id || '.csv' as source_file from clean "
            "where amount > 200000"
        ),
    ),
    "validated_files": (validated_files, report("select * from clean")),
    "stored_errors": (stored_errors, report("select *, 'r1' as run_id from errors")),
    "ingested_rows": (ingested_rows, _over_files(f"select {_TARGET}, 's1@x.test' as uploaded_by from clean")),
    "ingested_verdicts": (ingested_verdicts, _over_files("select * from verdicts")),
    "ingested_errors": (ingested_errors, _over_files("select * from errors")),
    "streamed_table_rows": (
        streamed_table_rows,
        _over_files(f"select {_TARGET}, 's1@x.test' as uploaded_by from clean"),
    ),
    "overwritten_table": (
        overwritten_table,
        report(
            f"select {_TARGET}, 's1@x.test' as uploaded_by, 'orders_' || upload_id || '.csv' as source_file, "
            "(select count(*) from raw_orders_columns where is_pii)::int as comments from clean where amount > 200000",
            "raw_orders raw_orders_templates raw_orders_columns",
        ),
    ),
    "nested_uploads": (
        nested_uploads,
        with_views(
            "filed_orders",
            "select 'upload_id=' || upload_id as folder, count(*) as total_rows from filed_orders group by upload_id",
        ),
    ),
    "multi_line_texts": (
        multi_line_texts,
        "select doc_id, nullif(trim(text, ' '), '') as text, lang from documents",
    ),
    "ingested_history": (ingested_history, _over_files(_EVENTS_SQL)),
    "ingested_log": (ingested_log, _over_files(_LOG_SQL)),
    "streamed_outcomes": (
        streamed_outcomes,
        _over_files("select upload_id, outcome as status from verdicts union all select 0, 'failed'"),
    ),
    "bad_bytes": (
        bad_bytes,
        r"""with lines as (select doc_id // 500 as part, doc_id, doc_id % 97 = 5 as bad,
    replace(coalesce(text, ''), chr(10), ' ') as line from documents),
placed as (select *, strlen(line) + 1 + bad::int as bytes, min(doc_id) filter (bad) over (partition by part) as first from lines)
select part, sum(bytes)::bigint as length,
  (sum(bytes) filter (doc_id < first) + any_value(strlen(substr(line, 1, 7))) filter (doc_id = first))::bigint as first_bad_byte
from placed where first is not null group by part""",
    ),
    "streamed_rows": (streamed_rows, _over_files(f"select {_TARGET}, 's1@x.test' as uploaded_by from clean")),
}
