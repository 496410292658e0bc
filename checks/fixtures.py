"""Registry tables and uploads derived from the given tables, for Spark and for SQL.

Each view is one SQL text that runs in both engines. `{name}` refers to another view or a
given table; `{TS}` is the zone-free timestamp type and `{part4}` repeats each part four
times with k = 0..3.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from sluicegate.sources.workspace import materialise

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()

# Rows per uploaded file, so that no file grows with the data.
FILE_ROWS = 1_000_000

VIEWS = {
    "raw_orders": """
        select cast(year(o_orderdate) * 100 + month(o_orderdate) as bigint) as upload_id,
          cast((year(o_orderdate) * 100 + month(o_orderdate)) % 5 as int) as template_id,
          o_orderkey + 1 as row_number,
          case when month(o_orderdate) <> 12 and o_orderkey % 97 = 1 then 'DUP'
            else cast(o_orderkey as string) end as order_code,
          case when month(o_orderdate) <> 12 and o_orderkey % 53 = 0 then ''
               when month(o_orderdate) <> 12 and o_orderkey % 59 = 0 then null
               when month(o_orderdate) <> 12 and o_orderkey % 211 = 7 then '12.0'
               else cast(o_custkey as string) end as cust_code,
          case when month(o_orderdate) <> 12 and o_orderkey % 71 = 0 then 'N/A'
               when month(o_orderdate) <> 12 and o_orderkey % 223 = 5 then '1.999'
               when month(o_orderdate) <> 12 and o_orderkey % 227 = 5 then '1.990'
               else cast(cast(o_totalprice as decimal(12,2)) as string) end as amount,
          case when month(o_orderdate) <> 12 and o_orderkey % 83 = 0 then '2024-13-45'
               when month(o_orderdate) <> 12 and o_orderkey % 229 = 5 then '2024-01-05Tjunk'
               when month(o_orderdate) <> 12 and o_orderkey % 233 = 5 then '2024'
               else cast(cast(o_orderdate as date) as string) end as order_date,
          o_orderpriority as note
        from {orders}""",
    # The same rows as files of bounded length: the upload is the file.
    "filed_orders": f"""
        select upload_id * 1000 + cast(floor(row_number / {FILE_ROWS}) as bigint) as upload_id, template_id,
          row_number as order_number, order_code, cust_code, amount, order_date, note
        from {{raw_orders}}""",
    "raw_orders_columns": """
        select * from (values
          (0, 'order_code', 'STRING',        true, false, false, true),
          (1, 'cust_code',  'BIGINT',        true, true,  false, false),
          (2, 'amount',     'DECIMAL(12,2)', true, false, false, false),
          (3, 'order_date', 'DATE',          true, false, false, false),
          (4, 'note',       'STRING',        true, false, true,  false)
        ) as t(column_order, column_name, data_type, is_included, is_pii, is_nullable, is_unique)""",
    "raw_orders_templates": """
        select * from (values
          (0, cast(0.00 as decimal(5,2)), 'fail'), (1, cast(5.00 as decimal(5,2)), 'drop'),
          (2, cast(8.00 as decimal(5,2)), 'fail'), (3, cast(8.00 as decimal(5,2)), 'drop'),
          (4, cast(100.00 as decimal(5,2)), 'drop')
        ) as t(template_id, bad_row_threshold, bad_row_action)""",
    "raw_documents": """
        select doc_id, doc_id + 1 as row_number, lang,
          case when doc_id % 13 = 0 then concat(substr(text, 1, 5), '\N{REPLACEMENT CHARACTER}', substr(text, 6))
            else text end as text, n_chars
        from {documents}""",
    "domains": """
        select r_regionkey as id, r_name as name, replace(lower(trim(r_name)), ' ', '_') as uc_schema_name
        from {region}""",
    "templates": """
        select p_partkey as id, concat('t_', cast(p_partkey as string)) as name, p_name as display_name,
          p_type as description, cast(p_partkey % 5 as int) as domain_id,
          concat('t_', cast(p_partkey as string)) as uc_table_name,
          concat('main.', replace(lower(trim(r_name)), ' ', '_'), '.t_', cast(p_partkey as string))
            as fully_qualified_name,
          case p_partkey % 4 when 0 then 'append' else 'overwrite' end as write_mode,
          cast(p_partkey % 20 as decimal(5,2)) as bad_row_threshold,
          case p_partkey % 2 when 0 then 'fail' else 'drop' end as bad_row_action,
          case p_size % 4 when 0 then null when 1 then ''
            else concat('readers_', cast(p_partkey % 5 as string)) end as reader_group,
          case p_size % 7 when 0 then 'Draft' when 1 then 'Pending Approval' when 2 then 'Pending DDL'
            when 3 then 'Approved' when 4 then 'Rejected' when 5 then 'DDL Failed' else 'Deprecated' end as status,
          cast(1 + p_partkey % 3 as int) as version,
          case when p_partkey % 3 = 0 then null else p_partkey - p_partkey % 3 end as parent_template_id,
          concat('s', cast(p_partkey % 20 as string), '@x.test') as created_by,
          cast('2024-01-01 00:00:00' as {TS}) + interval '1' hour * p_partkey as created_at
        from {part} left join {region} on r_regionkey = p_partkey % 5""",
    "template_columns": """
        select p_partkey as template_id, concat('c_', cast(k as string)) as column_name,
          case k when 0 then 'STRING' when 1 then 'INTEGER' when 2 then 'DATE' else 'DECIMAL' end as data_type,
          case when k = 1 then null else concat('it''s column ', cast(k as string)) end as description,
          not (p_partkey % 10 = 8 or k = 3) as is_included, (k = 0 and p_partkey % 2 = 0) as is_pii,
          k <> 0 as is_nullable, k = 0 as is_unique, cast(3 - k as int) as column_order
        from {part4} as v
        where p_partkey % 10 <> 9""",
    "template_reviewers": """
        select distinct l_partkey as template_id, concat('s', cast(l_suppkey as string), '@x.test') as reviewer_email,
          case when l_suppkey % 10 = 0 then 'required' else 'optional' end as reviewer_type
        from {lineitem}""",
    "template_approvals": """
        select l_partkey as template_id, concat('s', cast(l_suppkey as string), '@x.test') as reviewer_email,
          case l_returnflag when 'A' then 'approved' when 'R' then 'rejected' else null end as action,
          l_returnflag <> 'N' as token_used,
          concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_suppkey as string))
            as approval_token,
          case when year(l_shipdate) < 1998 then 1 else 2 end as round,
          cast(l_shipdate as {TS}) as created_at,
          cast(l_shipdate as {TS}) + interval '30' day as token_expires_at,
          case when l_returnflag = 'N' then null else cast(l_shipdate as {TS}) + interval '2' day end as actioned_at
        from {lineitem}""",
    # One row per token: the smallest of its approval rows, field by field.
    "token_approvals": """
        select approval_token, a.template_id, a.reviewer_email, a.created_at, a.token_used, a.token_expires_at,
          a.round, a.action
        from (
          select approval_token, min({STRUCT}(template_id, reviewer_email, created_at, token_used,
            token_expires_at, round, action)) as a
          from {template_approvals} group by approval_token) as x""",
    "upload_history": """
        select o_orderkey as id, case when o_custkey % 97 = 0 then -1 else o_custkey % 100 end as template_id,
          concat('s', cast(o_custkey % 20 as string), '@x.test') as uploaded_by, o_orderdate as uploaded_at,
          cast(floor(o_totalprice) as bigint) % 1000 + 1 as total_rows,
          case o_orderstatus when 'P' then (cast(floor(o_totalprice) as bigint) % 1000 + 1) % 7 else 0 end
            as dropped_rows,
          case o_orderstatus when 'F' then 'failed' when 'O' then 'completed' else 'partial' end as status
        from {orders}""",
    "upload_step_events": """
        select event_id, user_id as upload_id, ts,
          case event_type when 'signup' then 'file_uploaded' when 'view' then 'schema_validated'
            when 'click' then 'constraints_checked' when 'purchase' then 'completed' else 'failed' end as status
        from {events}""",
    # Every request is decided once, soon after it was made, and those of every fourth order
    # once more by then-used or expired tokens.
    "decisions": """
        select decision_id, decided_at,
          case when decision_id % 11 = 0 then concat('unknown-', cast(decision_id as string)) else token end as token,
          decision
        from (
          select l_orderkey * 20 + l_linenumber as decision_id,
            min(cast(l_shipdate as {TS})) + interval '3' day as decided_at,
            min(concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_suppkey as string)))
              as token,
            case when l_orderkey % 5 = 0 then 'reject' else 'approve' end as decision
          from {lineitem} group by l_orderkey, l_linenumber
          union all
          select l_orderkey * 20 + 10 + l_linenumber, min(cast(o_orderdate as {TS})) + interval '90' day,
            min(concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_suppkey as string))),
            'approve'
          from {lineitem} join {orders} on l_orderkey = o_orderkey
          where o_orderkey % 4 = 0 group by l_orderkey, l_linenumber) as d""",
    "lifecycle_events": """
        select event_id, user_id as template_id, ts,
          case event_type when 'signup' then 'Pending Approval' when 'view' then 'Pending DDL'
            when 'purchase' then 'Approved' when 'error' then 'Draft' else 'Deprecated' end as to_status
        from {events}""",
    "patches": """
        select p_partkey as id, p_partkey % 2 = 0 as has_description,
          case when p_partkey % 4 = 0 then null else concat('new ', p_name) end as description,
          p_partkey % 3 = 0 as has_write_mode, 'append' as write_mode
        from {part}""",
    "principals": "select * from (values ('readers_0'), ('readers_1'), ('readers_2')) as t(group_name)",
}

_REFERENCE = re.compile(r"\{(\w+)\}")


def _references(name: str) -> list[str]:
    found = _REFERENCE.findall(VIEWS[name])
    return [r for r in dict.fromkeys(found) if r not in ("TS", "STRUCT")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture as a DataFrame."""
    sources = {}
    for ref in _references(name):
        if ref == "part4":
            sources[ref] = table(spark, sf_dir, "part").selectExpr("*", "explode(array(0, 1, 2, 3)) as k")
        elif ref in TABLES:
            sources[ref] = table(spark, sf_dir, ref)
        else:
            sources[ref] = view(spark, sf_dir, ref)
    if name in DEALT:
        source, key = DEALT[name]
        sources[source] = sources[source].repartition(key)
    text = VIEWS[name].replace("{TS}", "timestamp_ntz").replace("{STRUCT}", "struct")
    return spark.sql(text, **sources) if sources else spark.sql(text)


# Views that stand for uploaded rows and large registry tables, with a key that spreads
# them over files. Operators read such input from storage, not from a running query.
# Those of aggregates lie over files already.
STORED = {"raw_orders": "row_number", "decisions": None, "token_approvals": None}

# Views that group nearly unique keys: their source is dealt by the key first, so that rows are
# sorted once, in tasks of bounded size, and not in those of the scan as well.
DEALT = {"decisions": ("lineitem", "l_orderkey"), "token_approvals": ("template_approvals", "approval_token")}

_stored: dict[tuple[str, str, str], DataFrame] = {}


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture written to the shared folder once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        rows = view(spark, sf_dir, name)
        if STORED[name]:
            rows = rows.repartition(spark.sparkContext.defaultParallelism, STORED[name])
        _stored[key] = materialise(rows, name)
    return _stored[key]


def with_views(names: str, query: str) -> str:
    """A SQL query for the other engine with the fixtures it needs in a WITH clause."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for ref in _references(name):
            if ref not in TABLES and ref != "part4":
                add(ref)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    clauses = []
    for name in ordered:
        text = VIEWS[name]
        if name == "token_approvals":
            text = """
        select approval_token, template_id, reviewer_email, created_at, token_used, token_expires_at, round, action
        from (select *, row_number() over (partition by approval_token order by template_id, reviewer_email,
            created_at, token_used, token_expires_at, round, action nulls first) as rn
          from {template_approvals}) as x where rn = 1"""
        text = text.replace("{TS}", "timestamp").replace(
            "{part4}", "(select *, unnest([0, 1, 2, 3]) as k from part)"
        )
        clauses.append(f"{name} as ({_REFERENCE.sub(lambda m: m.group(1), text)})")
    return "with " + ",\n".join(clauses) + "\n" + query
