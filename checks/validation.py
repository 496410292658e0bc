"""Registered queries of file validation, clean write and upload history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixtures import stored, table, view, with_views
from sluicegate.functions.text import html_to_text
from sluicegate.model import ColumnConfig, TemplateConfig
from sluicegate.operators import gates, history, publish, validate

ORDER_COLUMNS = (
    ColumnConfig("order_code", "STRING", is_nullable=False, is_unique=True, column_order=0),
    ColumnConfig("cust_code", "BIGINT", is_pii=True, is_nullable=False, column_order=1),
    ColumnConfig("amount", "DECIMAL(12,2)", is_nullable=False, column_order=2),
    ColumnConfig("order_date", "DATE", is_nullable=False, column_order=3),
    ColumnConfig("note", "STRING", column_order=4),
)
ORDERS = TemplateConfig(columns=ORDER_COLUMNS, template_id="orders", fully_qualified_name="orders_target")
NAMES = [c.column_name for c in ORDER_COLUMNS]
DOCUMENTS = TemplateConfig(
    columns=(ColumnConfig("lang", column_order=0), ColumnConfig("text", is_pii=True, column_order=1)),
    template_id="documents",
)

# The error report over raw_orders, written against `raw_orders` or a view of that shape.
NARROW_SQL = """
  select upload_id, row_number, 'order_code' as column_name, 'NOT_NULL' as error_type,
    'Value is required' as error_message, order_code as raw_value
    from {rows} where order_code is null or trim(order_code) = ''
  union all select upload_id, row_number, 'cust_code', 'NOT_NULL', 'Value is required', cust_code
    from {rows} where cust_code is null or trim(cust_code) = ''
  union all select upload_id, row_number, 'amount', 'NOT_NULL', 'Value is required', amount
    from {rows} where amount is null or trim(amount) = ''
  union all select upload_id, row_number, 'order_date', 'NOT_NULL', 'Value is required', order_date
    from {rows} where order_date is null or trim(order_date) = ''
  union all select upload_id, row_number, 'cust_code', 'TYPE_MISMATCH', 'Value is not a valid BIGINT', cust_code
    from {rows} where trim(cust_code) <> '' and not (try_cast(cust_code as bigint) is not null
      and regexp_full_match(trim(cust_code), '[+-]?[0-9]+'))
  union all select upload_id, row_number, 'amount', 'TYPE_MISMATCH', 'Value is not a valid DECIMAL(12,2)', amount
    from {rows} where trim(amount) <> '' and not (try_cast(amount as decimal(12,2)) is not null
      and try_cast(amount as decimal(12,2)) = try_cast(amount as decimal(30,15)))
  union all select upload_id, row_number, 'order_date', 'TYPE_MISMATCH', 'Value is not a valid DATE', order_date
    from {rows} where trim(order_date) <> '' and not (try_cast(order_date as date) is not null
      and regexp_full_match(trim(order_date), '[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}'))"""
UNIQUE_SQL = """
  select upload_id, row_number, 'order_code' as column_name, 'UNIQUE' as error_type,
    'Value occurs more than once' as error_message, order_code as raw_value
    from (select *, count(*) over (partition by upload_id, trim(order_code)) as n from {rows}
      where trim(order_code) <> '') as u where n > 1"""
ERRORS_SQL = NARROW_SQL + "\n  union all" + UNIQUE_SQL
VERDICT_SQL = """
  select upload_id, template_id, total_rows, invalid_rows, total_rows - invalid_rows as valid_rows,
    case when outcome = 'partial' then invalid_rows else 0 end as dropped_rows,
    cast(invalid_rows * 100 as double) / total_rows as bad_pct, outcome
  from (select t.upload_id, t.template_id, total_rows, coalesce(invalid_rows, 0) as invalid_rows,
      case when coalesce(invalid_rows, 0) * 100 > bad_row_threshold * total_rows then 'failed'
        when bad_row_action = 'fail' and coalesce(invalid_rows, 0) > 0 then 'failed'
        when coalesce(invalid_rows, 0) > 0 then 'partial' else 'completed' end as outcome
    from (select upload_id, template_id, count(*) as total_rows from {rows} group by upload_id, template_id) as t
    left join (select upload_id, count(distinct row_number) as invalid_rows from errors group by upload_id) as e
      on e.upload_id = t.upload_id
    join raw_orders_templates as p on p.template_id = t.template_id) as j"""
CLEAN_SQL = """
  select upload_id, row_number, order_code, try_cast(cust_code as bigint) as cust_code,
    try_cast(amount as decimal(12,2)) as amount, try_cast(order_date as date) as order_date, note
  from {rows} as r
  where not exists (select 1 from errors as e where e.upload_id = r.upload_id and e.row_number = r.row_number)
    and upload_id in (select upload_id from verdicts where outcome <> 'failed')"""
TYPED_SQL = """
  select upload_id, row_number, nullif(trim(order_code), '') as order_code,
    case when regexp_full_match(trim(cust_code), '[+-]?[0-9]+') then try_cast(cust_code as bigint) end as cust_code,
    case when try_cast(amount as decimal(12,2)) = try_cast(amount as decimal(30,15))
      then try_cast(amount as decimal(12,2)) end as amount,
    case when regexp_full_match(trim(order_date), '[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}')
      then try_cast(order_date as date) end as order_date, note from raw_orders"""


def report(last: str, views: str = "raw_orders raw_orders_templates", rows: str = "raw_orders") -> str:
    """`last` over the views errors, verdicts and clean."""
    parts = {"errors": ERRORS_SQL, "verdicts": VERDICT_SQL, "clean": CLEAN_SQL}
    ctes = "".join(f",\n{name} as ({sql.replace('{rows}', rows)})" for name, sql in parts.items())
    return with_views(views, "").rstrip() + ctes + "\n" + last


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "raw_orders")


def _verdicts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _orders(spark, sf)
    return validate.verdict(rows, validate.validate(rows, ORDERS), view(spark, sf, "raw_orders_templates"))


def _errors(spark: SparkSession, sf: str) -> DataFrame:
    return validate.validate(_orders(spark, sf), ORDERS)


def _clean(spark: SparkSession, sf: str) -> DataFrame:
    rows = _orders(spark, sf)
    repeated = validate.unique_errors(rows, ORDERS)
    errors = validate.validate(rows, ORDERS, repeated)
    verdicts = validate.verdict(rows, errors, view(spark, sf, "raw_orders_templates"))
    return validate.clean_rows(rows, ORDERS, verdicts, repeated)


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    return validate.typed_rows(_orders(spark, sf), ORDERS)


def _rules():
    return publish.expectations(ORDERS, {"amount_limit": "amount < 400000"})


def inferred_types(spark, sf):
    return gates.infer_types(_orders(spark, sf).select(*NAMES))


def header_check(spark, sf):
    """One file per template, its header damaged in one of five ways."""
    columns = view(spark, sf, "template_columns")
    expected = gates.expected_headers(columns)
    e = F.col("expected")
    damaged = (
        F.when(F.col("template_id") % 5 == 1, F.slice(e, 2, 3))
        .when(F.col("template_id") % 5 == 2, F.concat(e, F.array(F.lit("surplus"))))
        .when(F.col("template_id") % 5 == 3, F.reverse(e))
        .when(F.col("template_id") % 5 == 4, F.concat(F.slice(e, 1, 3), F.array(F.element_at(e, 1))))
        .otherwise(e)
    )
    headers = expected.select(F.col("template_id").alias("upload_id"), "template_id", damaged.alias("header"))
    checked = gates.check_headers(headers, columns)
    return checked.select(
        "upload_id",
        "expected_columns",
        "actual_columns",
        *[F.array_join(c, ",").alias(c) for c in ("missing", "extra", "misplaced", "repeated")],
        "header_ok",
    )


def header_error_rows(spark, sf):
    columns = view(spark, sf, "template_columns")
    headers = gates.expected_headers(columns).select(
        F.col("template_id").alias("upload_id"),
        "template_id",
        F.when(F.col("template_id") % 2 == 0, F.col("expected")).otherwise(F.slice("expected", 2, 3)).alias("header"),
    )
    found = gates.header_errors(gates.check_headers(headers, columns))
    return found.select("upload_id", "row_number", "column_name", "error_type", "error_message")


def document_gates(spark, sf):
    files = table(spark, sf, "documents").select(
        F.concat(
            F.lit("landing/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 9 == 0, ".txt").otherwise(".csv")
        ).alias("path"),
        F.col("n_chars").alias("length"),
    )
    return gates.upload_gates(files, max_bytes=2000)


def document_encoding_errors(spark, sf):
    rows = view(spark, sf, "raw_documents").withColumn("upload_id", F.col("doc_id") % 7)
    return validate.encoding_errors(rows, DOCUMENTS)


def expectations_kept(spark, sf):
    return publish.expect_or_drop(_typed(spark, sf), _rules())


def expectation_log(spark, sf):
    return publish.expectation_log(_typed(spark, sf), _rules(), ("upload_id",))


def audit_columns(spark, sf):
    stored = F.concat(F.lit("orders_"), F.col("upload_id").cast("string"), F.lit(".csv"))
    rows = publish.with_audit_columns(_clean(spark, sf), "s1@x.test", "2024-02-01 00:00:00", stored)
    return rows.withColumn("uploaded_at", F.col("uploaded_at").cast("string"))


def upload_results(spark, sf):
    templates = view(spark, sf, "raw_orders_templates").select(
        "*",
        F.concat(F.lit("t_"), F.col("template_id").cast("string")).alias("name"),
        F.concat(F.lit("main.orders.t_"), F.col("template_id").cast("string")).alias("fully_qualified_name"),
    )
    uploads = _orders(spark, sf).groupBy("upload_id").agg(
        F.concat(F.lit("s"), (F.col("upload_id") % 20).cast("string"), F.lit("@x.test")).alias("uploaded_by"),
        F.min("order_date").alias("uploaded_at"),
    )
    return history.upload_results(_verdicts(spark, sf), templates, uploads)


def pages_as_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", html_to_text("html").alias("text"))


def history_page(spark, sf):
    return history.list_uploads(view(spark, sf, "upload_history"), template_id=3, status="failed", limit=200)


QUERIES = {
    "cell_error_report": (_errors, report("select * from errors")),
    "type_mismatches": (
        lambda s, d: validate.type_errors(_orders(s, d), ORDERS),
        report("select * from errors where error_type = 'TYPE_MISMATCH'"),
    ),
    "missing_values": (
        lambda s, d: validate.not_null_errors(_orders(s, d), ORDERS),
        report("select * from errors where error_type = 'NOT_NULL'"),
    ),
    "repeated_values": (
        lambda s, d: validate.unique_errors(_orders(s, d), ORDERS),
        report("select * from errors where error_type = 'UNIQUE'"),
    ),
    "encoding_errors": (
        document_encoding_errors,
        with_views(
            "raw_documents",
            "select doc_id % 7 as upload_id, row_number, 'text' as column_name, 'ENCODING_ERROR' as error_type, "
            "'Value is not valid UTF-8' as error_message, text as raw_value from raw_documents "
            "where contains(text, '\N{REPLACEMENT CHARACTER}')",
        ),
    ),
    "upload_verdict": (_verdicts, report("select * from verdicts")),
    "clean_rows": (_clean, report("select * from clean")),
    "error_summary": (
        lambda s, d: history.error_summary(_errors(s, d)),
        report(
            "select upload_id, error_type, column_name, count(*) as errors, count(distinct row_number) as bad_rows, "
            "min(row_number) as first_row, arg_min_null(raw_value, row_number) as first_value "
            "from errors group by upload_id, error_type, column_name"
        ),
    ),
    "error_totals": (
        lambda s, d: history.error_totals(_errors(s, d)),
        report(
            "select error_type, column_name, cast(grouping(error_type, column_name) as int) as level, "
            "count(*) as errors from errors group by rollup (error_type, column_name)"
        ),
    ),
    "error_text": (
        lambda s, d: history.error_text(_errors(s, d)),
        report(
            "select upload_id, cast(sum(n) as bigint) as errors, string_agg(error_type || ' ' || column_name || ': ' || "
            "cast(n as varchar), '; ' order by error_type, column_name) as error_summary from "
            "(select upload_id, error_type, column_name, count(*) as n from errors group by all) as c group by upload_id"
        ),
    ),
    "inferred_types": (
        inferred_types,
        with_views(
            "raw_orders",
            "select position, column_name, case when non_blank = 0 then 'STRING' when ints = non_blank then 'INTEGER' "
            "when longs = non_blank then 'BIGINT' when plain = non_blank and whole + scale <= 38 "
            "then 'DECIMAL(' || (whole + scale) || ',' || scale || ')' when doubles = non_blank then 'DOUBLE' "
            "when dates = non_blank then 'DATE' else 'STRING' end as data_type, non_blank, blank from "
            "(select position, column_name, count(*) filter (where v <> '') as non_blank, "
            "count(*) filter (where coalesce(v, '') = '') as blank, "
            "count(*) filter (where regexp_full_match(v, '-?[0-9]{1,9}')) as ints, "
            "count(*) filter (where regexp_full_match(v, '-?[0-9]{1,18}')) as longs, "
            "count(*) filter (where regexp_full_match(v, '[+-]?[0-9]+([.][0-9]*)?')) as plain, "
            "max(length(regexp_extract(v, '^[+-]?([0-9]+)([.][0-9]*)?$', 1))) as whole, "
            "max(length(regexp_extract(v, '^[+-]?[0-9]+[.]([0-9]*)$', 1))) as scale, "
            "count(*) filter (where try_cast(v as double) is not null) as doubles, "
            "count(*) filter (where try_cast(v as date) is not null and length(v) between 8 and 10) as dates from ("
            + " union all ".join(
                f"select {i} as position, '{n}' as column_name, trim({n}) as v from raw_orders"
                for i, n in enumerate(NAMES)
            )
            + ") as cells group by position, column_name) as counted",
        ),
    ),
    "header_check": (
        header_check,
        with_views(
            "template_columns",
            """, damaged as (
  select template_id, e, case template_id % 5 when 1 then e[2:4] when 2 then list_append(e, 'surplus')
    when 3 then list_reverse(e) when 4 then list_append(e[1:3], e[1]) else e end as h
  from (select template_id, list(column_name order by column_order) as e from template_columns group by template_id) as x)
select template_id as upload_id, cast(len(e) as int) as expected_columns, cast(len(h) as int) as actual_columns,
  coalesce(array_to_string(list_filter(e, lambda n: not list_contains(h, n)), ','), '') as missing,
  coalesce(array_to_string(list_filter(h, lambda n: not list_contains(e, n)), ','), '') as extra,
  coalesce(array_to_string(list_filter(e, lambda n: list_contains(h, n)
    and list_position(h, n) <> list_position(e, n)), ','), '') as misplaced,
  case when template_id % 5 = 4 then e[1] else '' end as repeated, h = e as header_ok
from damaged""",
        ),
    ),
    "header_errors": (
        header_error_rows,
        with_views(
            "template_columns",
            """, expected as (select *, row_number() over (partition by template_id order by column_order) as pos
  from template_columns where template_id % 2 = 1)
select template_id as upload_id, cast(0 as bigint) as row_number, column_name, 'SCHEMA_MISMATCH' as error_type,
  case pos when 1 then 'Column is missing from the header' else 'Column is at another position' end as error_message
from expected""",
        ),
    ),
    "upload_gates": (
        document_gates,
        "select 'landing/' || doc_id || case when doc_id % 9 = 0 then '.txt' else '.csv' end as path, "
        "n_chars as length, case when doc_id % 9 = 0 then 'wrong_extension' when n_chars > 2000 then 'too_large' "
        "else 'ok' end as gate from documents",
    ),
    "expectations_kept": (
        expectations_kept,
        with_views(
            "raw_orders",
            f"select * from ({TYPED_SQL}) as t where order_code is not null and cust_code is not null "
            "and amount is not null and order_date is not null and amount < 400000",
        ),
    ),
    "expectation_log": (
        expectation_log,
        with_views(
            "raw_orders",
            f", typed as ({TYPED_SQL}) "
            + " union all ".join(
                f"select upload_id, '{rule}' as rule, count(*) as processed, count(*) filter (where {test}) as passed, "
                f"count(*) - count(*) filter (where {test}) as dropped from typed group by upload_id"
                for rule, test in [
                    ("order_code_not_null", "order_code is not null"),
                    ("cust_code_not_null", "cust_code is not null"),
                    ("amount_not_null", "amount is not null"),
                    ("order_date_not_null", "order_date is not null"),
                    ("amount_limit", "amount < 400000"),
                ]
            ),
        ),
    ),
    "audit_columns": (
        audit_columns,
        report(
            "select *, 's1@x.test' as uploaded_by, '2024-02-01 00:00:00' as uploaded_at, "
            "'orders_' || upload_id || '.csv' as source_file from clean"
        ),
    ),
    "upload_results": (
        upload_results,
        report(
            """select v.upload_id, v.template_id, 't_' || v.template_id as template_name,
  'main.orders.t_' || v.template_id as fully_qualified_name, 's' || (v.upload_id % 20) || '@x.test' as uploaded_by,
  u.uploaded_at, outcome, total_rows, valid_rows, invalid_rows, dropped_rows,
  case when outcome = 'failed' and invalid_rows * 100 > bad_row_threshold * total_rows
      then 'Share of bad rows exceeds ' || cast(bad_row_threshold as varchar) || ' %'
    when outcome = 'failed' and invalid_rows > 0 then invalid_rows || ' bad rows and the template accepts none'
    when outcome = 'failed' then 'The file header does not match the template'
    when outcome = 'partial' then dropped_rows || ' bad rows dropped' end as reason
from verdicts as v join raw_orders_templates as p on p.template_id = v.template_id
join (select upload_id, min(order_date) as uploaded_at from raw_orders group by upload_id) as u
  on u.upload_id = v.upload_id"""
        ),
    ),
    "upload_current_state": (
        lambda s, d: history.current_uploads(view(s, d, "upload_step_events")),
        with_views(
            "upload_step_events",
            "select upload_id, event_id, ts, status, n_events from (select *, count(*) over (partition by upload_id) "
            "as n_events, row_number() over (partition by upload_id order by ts desc, event_id desc) as rn "
            "from upload_step_events) as x where rn = 1",
        ),
    ),
    "upload_progress": (
        lambda s, d: history.upload_progress(view(s, d, "upload_step_events")),
        with_views(
            "upload_step_events",
            """, numbered as (select *, row_number() over (partition by upload_id order by ts, event_id) as pos
  from upload_step_events),
failure as (select upload_id, min(pos) as failed_at from numbered where status = 'failed' group by upload_id),
steps as (select n.upload_id, n.pos, failed_at, n.status, case n.status when 'file_uploaded' then 1
    when 'schema_validated' then 2 when 'constraints_checked' then 3 when 'completed' then 4 else 0 end as step
  from numbered as n left join failure as f on f.upload_id = n.upload_id)
select upload_id, case when max(failed_at) is not null then 'failed' else arg_max(status, pos) end as status,
  cast(max(case when failed_at is null or pos < failed_at then step else 0 end) as int) as step_number,
  (max(failed_at) is not null or arg_max(status, pos) = 'completed') as is_terminal
from steps group by upload_id""",
        ),
    ),
    "upload_listing": (
        history_page,
        with_views(
            "upload_history",
            "select * from upload_history where template_id = 3 and status = 'failed' "
            "order by uploaded_at desc, id limit 200",
        ),
    ),
    "quality_by_day": (
        lambda s, d: history.quality_by_day(view(s, d, "upload_history")),
        with_views(
            "upload_history",
            "select template_id, cast(uploaded_at as date) as day, count(*) as uploads, "
            "cast(sum(total_rows) as bigint) as total_rows, cast(sum(dropped_rows) as bigint) as dropped_rows, "
            "cast(sum(dropped_rows) * 100 as double) / sum(total_rows) as dropped_pct "
            "from upload_history group by 1, 2",
        ),
    ),
    "pages_as_text": (
        pages_as_text,
        "select page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), "
        "'[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', "
        "' ', 'g'), ' ') as text from pages",
    ),
}
