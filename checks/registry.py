"""Registered queries of the template registry and of provisioning."""

from __future__ import annotations

import dataclasses
import uuid
from concurrent.futures import ThreadPoolExecutor
from itertools import batched

from pyspark.sql import functions as F

from checks.fixtures import table, view, with_views
from sluicegate.functions.text import mask_pii, schema_name
from sluicegate.model import ColumnConfig, TemplateConfig
from sluicegate.operators import provision, registry
from sluicegate.sources.bootstrap import missing_tables, seed

CATALOG = "main"
# Templates of which the driver holds the configs and the columns found.
TABLES_AT_A_TIME = 20_000
PARTS = TemplateConfig(
    columns=(
        ColumnConfig("p_partkey", "BIGINT", column_order=0),
        ColumnConfig("p_name", "STRING", is_pii=True, column_order=1),
        ColumnConfig("p_size", "INTEGER", is_pii=True, column_order=2),
        ColumnConfig("p_brand", "STRING", is_pii=True, is_included=False, column_order=3),
    )
)


def _views(spark, sf, *names):
    return [view(spark, sf, n) for n in names]


def domain_seed(spark, sf):
    """Nations and regions offered as new domains; regions exist already."""
    new = table(spark, sf, "nation").select(F.col("n_name").alias("name")).unionByName(
        table(spark, sf, "region").select(F.col("r_name").alias("name"))
    )
    offered = new.select("name", schema_name("name").alias("uc_schema_name"))
    return seed(offered, view(spark, sf, "domains"), "uc_schema_name")


def search_page(spark, sf):
    return registry.search_templates(
        view(spark, sf, "templates"), status="Approved", search="T_1", limit=40, offset=5
    )


def creator_page(spark, sf):
    return registry.search_templates(view(spark, sf, "templates"), domain_id=2, created_by="s7@x.test", limit=200)


def found_templates(spark, sf):
    requests = table(spark, sf, "supplier").select((F.col("s_suppkey") * 37).alias("id"))
    return registry.lookup(requests, view(spark, sf, "templates"))


def nested_configs(spark, sf):
    configs = registry.template_configs(*_views(spark, sf, "templates", "domains", "template_columns"), CATALOG)
    text = F.transform(
        "columns",
        lambda c: F.concat_ws(
            ":", c.column_name, c.data_type, c.description, c.is_included.cast("string"), c.is_pii.cast("string"),
            c.is_nullable.cast("string"), c.is_unique.cast("string"), c.column_order.cast("string"),
        ),
    )
    return configs.withColumn("columns", F.array_join(text, "; "))


def _requests(spark, sf):
    return table(spark, sf, "part").select(
        (F.col("p_partkey") + 10_000_000).alias("id"),
        F.concat(F.lit("n_"), F.col("p_partkey").cast("string")).alias("name"),
        F.col("p_name").alias("display_name"),
        F.col("p_type").alias("description"),
        (F.col("p_partkey") % 6).cast("int").alias("domain_id"),
        F.lit("s1@x.test").alias("created_by"),
        F.lit("2024-02-01 00:00:00").cast("timestamp_ntz").alias("requested_at"),
    )


def registered_templates(spark, sf):
    return registry.register(_requests(spark, sf), view(spark, sf, "domains"), CATALOG)


def refused_registrations(spark, sf):
    return registry.unknown_domains(_requests(spark, sf), view(spark, sf, "domains")).select("id", "domain_id")


def colliding_names(spark, sf):
    """Every name is proposed again, half of them by the template that owns it."""
    requests = table(spark, sf, "part").select(
        (F.col("p_partkey") + F.when(F.col("p_partkey") % 2 == 0, 0).otherwise(10_000_000)).alias("id"),
        F.concat(F.lit("t_"), F.col("p_partkey").cast("string")).alias("name"),
    )
    tables = table(spark, sf, "supplier").select(
        F.concat(F.lit("t_"), F.col("s_suppkey").cast("string")).alias("table_name")
    )
    return registry.name_collisions(requests, view(spark, sf, "templates"), tables)


def repeated_columns(spark, sf):
    """All columns, and the first one again for every fourth template."""
    columns = view(spark, sf, "template_columns").select("template_id", "column_name")
    return registry.duplicate_columns(
        columns.unionByName(columns.filter("template_id % 4 = 0 and column_name = 'c_0'"))
    )


def repeated_reviewers(spark, sf):
    """One row per line item; every other address in upper case."""
    rows = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("template_id"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("S"), F.col("l_suppkey").cast("string"), F.lit("@X.TEST")))
        .otherwise(F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit("@x.test")))
        .alias("reviewer_email"),
    )
    return registry.duplicate_reviewers(rows)


def reviewing_creators(spark, sf):
    reviewers = view(spark, sf, "template_reviewers").withColumn("reviewer_email", F.upper("reviewer_email"))
    return registry.creators_as_reviewers(reviewers, view(spark, sf, "templates"))


def template_rule_audit(spark, sf):
    """Templates with faults planted in several fields."""
    t = view(spark, sf, "templates")
    faulty = t.withColumns(
        {
            "name": F.when(F.col("id") % 11 == 0, F.upper("name")).when(F.col("id") % 13 == 0, "t").otherwise(F.col("name")),
            "display_name": F.when(F.col("id") % 17 == 0, "").otherwise(F.col("display_name")),
            "bad_row_threshold": F.when(F.col("id") % 19 == 0, F.lit(101)).otherwise(F.col("bad_row_threshold")).cast(
                "decimal(5,2)"
            ),
            "status": F.when(F.col("id") % 23 == 0, "Active").otherwise(F.col("status")),
            "delimiter": F.when(F.col("id") % 29 == 0, "||").otherwise(","),
        }
    )
    return registry.audit_rules(faulty, registry.registry_rules("templates"), partial=True)


def column_rule_audit(spark, sf):
    columns = view(spark, sf, "template_columns").withColumn(
        "data_type", F.when(F.col("template_id") % 9 == 0, "VARCHAR").otherwise(F.col("data_type"))
    )
    keyed = columns.withColumn("id", F.concat_ws("/", F.col("template_id").cast("string"), "column_name"))
    return registry.audit_rules(keyed, registry.registry_rules("template_columns"), partial=True)


def integrity(spark, sf):
    names = ("domains", "templates", "template_columns", "template_reviewers", "template_approvals", "upload_history")
    tables = {n: view(spark, sf, n) for n in names}
    # One error per line item, some of uploads that are not there.
    tables["upload_validation_errors"] = table(spark, sf, "lineitem").select(
        F.when(F.col("l_linenumber") == 7, -F.col("l_orderkey")).otherwise(F.col("l_orderkey")).alias("upload_id")
    )
    return registry.integrity_audit(tables)


def _planted(spark, sf, name: str, key: str, **changes):
    """A fixture with `id` and with fields replaced by SQL expressions."""
    rows = view(spark, sf, name).withColumn("id", F.expr(key))
    return rows.withColumns({field: F.expr(text) for field, text in changes.items()})


def reviewer_rule_audit(spark, sf):
    rows = _planted(
        spark,
        sf,
        "template_reviewers",
        "concat(cast(template_id as string), '/', reviewer_email)",
        reviewer_email="if(template_id % 7 = 0, replace(reviewer_email, '@', ' at '), reviewer_email)",
        reviewer_name="if(template_id % 5 = 0, null, reviewer_email)",
        reviewer_type="if(template_id % 11 = 0, 'observer', reviewer_type)",
    )
    return registry.audit_rules(rows, registry.registry_rules("template_reviewers"))


def approval_rule_audit(spark, sf):
    rows = _planted(
        spark,
        sf,
        "template_approvals",
        "approval_token",
        action="if(template_id % 7 = 0, 'maybe', action)",
        comment="if(template_id % 5 = 0, repeat('x', 501), null)",
    )
    return registry.audit_rules(rows, registry.registry_rules("template_approvals"))


def decision_rule_audit(spark, sf):
    rows = _planted(
        spark,
        sf,
        "decisions",
        "decision_id",
        decision="if(decision_id % 7 = 0, null, if(decision_id % 11 = 0, 'APPROVE', decision))",
        comment="if(decision_id % 5 = 0, repeat('x', 501), 'fine')",
    )
    return registry.audit_rules(rows, registry.registry_rules("decisions"))


def history_rule_audit(spark, sf):
    rows = _planted(spark, sf, "upload_history", "id", status="if(id % 7 = 0, 'success', status)")
    return registry.audit_rules(rows, registry.registry_rules("upload_history"))


def error_rule_audit(spark, sf):
    kinds = F.array(*[F.lit(k) for k in ("NOT_NULL", "UNIQUE", "TYPE_MISMATCH", "SCHEMA_MISMATCH", "ENCODING_ERROR", "ODD")])
    rows = table(spark, sf, "lineitem").select(
        F.concat_ws("/", "l_orderkey", "l_linenumber").alias("id"),
        F.get(kinds, (F.col("l_partkey") % 7).cast("int")).alias("error_type"),
    )
    return registry.audit_rules(rows, registry.registry_rules("upload_validation_errors"))


def missing_target_tables(spark, sf):
    """Tables of templates that a catalog listing, one per supplier, does not have."""
    expected = view(spark, sf, "templates").select(F.col("uc_table_name").alias("table_name"))
    there = table(spark, sf, "supplier").select(
        F.concat(F.lit("t_"), F.col("s_suppkey").cast("string")).alias("table_name")
    )
    return missing_tables(expected, there)


def patched_templates(spark, sf):
    return registry.patch(*_views(spark, sf, "templates", "patches"), ["description", "write_mode"])


def patch_outcomes(spark, sf):
    return registry.patch_outcomes(*_views(spark, sf, "templates", "patches"))


def _column_lists(spark, sf):
    def item(name, kind):
        return F.struct(
            name.alias("column_name"),
            F.lit(kind).alias("data_type"),
            F.lit(None).cast("string").alias("description"),
            F.lit(True).alias("is_included"),
            F.lit(False).alias("is_pii"),
            F.lit(True).alias("is_nullable"),
            F.lit(False).alias("is_unique"),
        )

    key = F.col("p_partkey")
    second = F.when(key % 4 == 2, F.lit("code")).otherwise(F.lit("amount"))
    items = F.array(item(F.lit("code"), "STRING"), item(second, "DOUBLE"))
    return table(spark, sf, "part").select(
        key.alias("template_id"), F.when(key % 5 != 0, items).alias("items")
    )


def replaced_columns(spark, sf):
    templates, columns = _views(spark, sf, "templates", "template_columns")
    return registry.replace_children(columns, templates, _column_lists(spark, sf), "column_name")


def replaced_column_outcomes(spark, sf):
    return registry.list_outcomes(view(spark, sf, "templates"), _column_lists(spark, sf), "column_name")


def replaced_reviewers(spark, sf):
    templates, reviewers = _views(spark, sf, "templates", "template_reviewers")
    key = F.col("p_partkey")

    def item(email, kind):
        return F.struct(email.alias("reviewer_email"), F.lit(kind).alias("reviewer_type"))

    first = F.concat(F.lit("S"), (key % 20 + key % 3 % 2).cast("string"), F.lit("@X.TEST"))
    lists = table(spark, sf, "part").select(
        key.alias("template_id"),
        F.array(item(first, "required"), item(F.lit("Extra@x.test"), "optional")).alias("items"),
    )
    return registry.replace_children(reviewers, templates, lists, "reviewer_email")


def _deletions(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"))


def _deleted(spark, sf):
    names = ("templates", "template_columns", "template_reviewers", "template_approvals", "upload_history")
    return registry.delete_templates({n: view(spark, sf, n) for n in names}, _deletions(spark, sf))


def delete_outcomes(spark, sf):
    templates, uploads = _views(spark, sf, "templates", "upload_history")
    return registry.delete_outcomes(templates, _deletions(spark, sf), uploads)


def remaining_rows(spark, sf):
    """Rows per template and table after the deletion."""
    left = _deleted(spark, sf)
    parts = [
        df.groupBy(F.col("id" if name == "templates" else "template_id").alias("template_id"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(name).alias("table_name"), "template_id", "n")
        for name, df in left.items()
    ]
    result = parts[0]
    for more in parts[1:]:
        result = result.unionByName(more)
    return result


def single_deletions(spark, sf):
    templates, columns = _views(spark, sf, "templates", "template_columns")
    requests = columns.filter("column_name = 'c_1'").select("template_id", "column_name")
    return registry.delete_children(columns, templates, requests, "column_name")


def cloned_versions(spark, sf):
    templates = view(spark, sf, "templates")
    requests = templates.select("id", (F.col("id") + 10_000_000).alias("new_id"))
    return registry.new_versions(templates, requests, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))


def ddl_texts(spark, sf):
    return provision.ddl_plan(*_views(spark, sf, "template_columns", "templates"))


def target_column_list(spark, sf):
    return provision.target_columns(view(spark, sf, "template_columns"))


def provisioned_columns(spark, sf):
    """The tables of all templates that wait for them, made in a database of their own, a second
    time without effect, and what the catalog then says of their columns."""
    templates, domains, columns = _views(spark, sf, "templates", "domains", "template_columns")
    pending = templates.filter("status = 'Pending DDL'")
    database = f"provisioned_{uuid.uuid4().hex}"
    spark.sql(f"create database {database}")
    configs = (
        dataclasses.replace(cfg, fully_qualified_name=f"{database}.{cfg.fully_qualified_name.split('.')[-1]}")
        for cfg in registry.load_configs(registry.template_configs(pending, domains, columns, CATALOG))
        if cfg.included
    )
    fields = "table_name string, position int, column_name string, data_type string, comment string"
    listed = spark.createDataFrame([], fields)
    for some in batched(configs, TABLES_AT_A_TIME):
        for _ in range(2):
            names = provision.provision(spark, some)
        with ThreadPoolExecutor(provision.STATEMENTS_AT_A_TIME) as pool:
            schemas = pool.map(lambda name: spark.table(name).schema, names)
        found = [
            (name.split(".")[1], i, f.name, f.dataType.simpleString(), f.metadata.get("comment"))
            for name, schema in zip(names, schemas)
            for i, f in enumerate(schema, 1)
        ]
        listed = listed.union(spark.createDataFrame(found, fields))
    spark.sql(f"drop database {database} cascade")
    return listed


def masked_documents(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(
        "doc_id",
        mask_pii(F.when(F.col("doc_id") % 3 != 0, F.col("source")), F.lit(False)).alias("masked"),
        mask_pii("lang", F.lit(False)).alias("short"),
        mask_pii("text", F.col("doc_id") % 2 == 0).alias("shown"),
    )


def masked_parts(spark, sf):
    return provision.masked_view(
        table(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_brand"), PARTS, False
    )


def grants(spark, sf):
    return provision.grant_plan(*_views(spark, sf, "templates", "domains", "principals"), CATALOG)


_TARGET_COLUMNS = """, included as (select template_id, column_name, data_type, is_nullable,
    cast(row_number() over (partition by template_id order by column_order) as integer) as position,
    case when is_pii and description <> '' then 'PII - masked | ' || description when is_pii then 'PII - masked'
      when description <> '' then description end as comment
  from template_columns where is_included),
targets as (select template_id, position, column_name, data_type, is_nullable, comment from included
  union all
  select template_id, width + n, name, kind, true, null
  from (select template_id, max(position) as width from included group by template_id) as w,
    (values (1, 'uploaded_by', 'STRING'), (2, 'uploaded_at', 'TIMESTAMP'), (3, 'source_file', 'STRING')) as a(n, name, kind))
"""
_VALID_LISTS = """
requests as (select p_partkey as template_id, status, p_partkey % 5 = 0 as is_empty, p_partkey % 4 = 2 as repeats
  from part left join templates on id = p_partkey),
outcomes as (select template_id, case when status is null then 'not_found' when status <> 'Draft' then 'not_draft'
    when is_empty then 'empty' when repeats then 'duplicate' else 'ok' end as outcome from requests)"""
_DELETE = """
outcomes as (select p_partkey as id, case when t.id is null then 'not_found' when t.status <> 'Draft' then 'not_draft'
    when p_partkey in (select template_id from upload_history) then 'has_uploads'
    when p_partkey in (select parent_template_id from templates where parent_template_id is not null) then 'is_parent'
    else 'ok' end as outcome
  from part left join templates as t on t.id = p_partkey),
gone as (select id from outcomes where outcome = 'ok')"""

QUERIES = {
    "domain_seed": (
        domain_seed,
        with_views(
            "domains",
            """, offered as (select name, lower(regexp_replace(trim(name), '[^A-Za-z0-9]+', '_', 'g')) as uc_schema_name
  from (select n_name as name from nation union all select r_name from region) as n)
select * from offered where uc_schema_name not in (select uc_schema_name from domains)""",
        ),
    ),
    "template_search": (
        search_page,
        with_views(
            "templates",
            "select * from templates where status = 'Approved' and (name ilike '%T_1%' or display_name ilike '%T_1%') "
            "order by created_at desc, id limit 40 offset 5",
        ),
    ),
    "template_search_by_creator": (
        creator_page,
        with_views(
            "templates",
            "select * from templates where domain_id = 2 and created_by = 's7@x.test' "
            "order by created_at desc, id limit 200",
        ),
    ),
    "domain_listing": (
        lambda s, d: registry.list_domains(view(s, d, "domains")),
        with_views("domains", "select * from domains order by name"),
    ),
    "column_listing": (
        lambda s, d: registry.list_columns(view(s, d, "template_columns"), 12),
        with_views("template_columns", "select * from template_columns where template_id = 12 order by column_order"),
    ),
    "reviewer_listing": (
        lambda s, d: registry.list_reviewers(view(s, d, "template_reviewers"), 12),
        with_views(
            "template_reviewers", "select * from template_reviewers where template_id = 12 order by reviewer_email"
        ),
    ),
    "template_lookup": (
        found_templates,
        "select distinct s_suppkey * 37 as id, s_suppkey * 37 in (select p_partkey from part) as found from supplier",
    ),
    "template_configs": (
        nested_configs,
        with_views(
            "templates domains template_columns",
            """select t.id as template_id, 'main' as catalog, uc_schema_name as schema, uc_table_name as "table",
  fully_qualified_name, coalesce(t.description, '') as description, reader_group, coalesce(c.columns, '') as columns
from templates as t join domains as d on d.id = t.domain_id
left join (select template_id, string_agg(concat_ws(':', column_name, data_type, coalesce(description, ''),
    cast(is_included as varchar), cast(is_pii as varchar), cast(is_nullable as varchar), cast(is_unique as varchar),
    cast(column_order as varchar)), '; ' order by column_order) as columns
  from template_columns group by template_id) as c on c.template_id = t.id""",
        ),
    ),
    "uploadable_templates": (
        lambda s, d: registry.uploadable_templates(*_views(s, d, "templates", "domains")),
        with_views(
            "templates domains",
            "select d.name as domain_name, t.id, t.name, display_name, version from templates as t "
            "join domains as d on d.id = t.domain_id where status = 'Approved'",
        ),
    ),
    "template_registration": (
        registered_templates,
        with_views(
            "domains",
            """select p_partkey + 10000000 as id, 'n_' || p_partkey as name, p_name as display_name,
  p_type as description, cast(p_partkey % 6 as int) as domain_id, 'n_' || p_partkey as uc_table_name,
  'main.' || uc_schema_name || '.n_' || p_partkey as fully_qualified_name, 'csv' as file_format, ',' as delimiter,
  'UTF-8' as encoding, 'append' as write_mode, cast(5 as decimal(5,2)) as bad_row_threshold,
  'drop' as bad_row_action, cast(null as varchar) as reader_group, 'Draft' as status, 1 as version,
  cast(null as bigint) as parent_template_id, 's1@x.test' as created_by,
  cast('2024-02-01 00:00:00' as timestamp) as created_at
from part join domains as d on d.id = p_partkey % 6""",
        ),
    ),
    "refused_registrations": (
        refused_registrations,
        "select p_partkey + 10000000 as id, cast(p_partkey % 6 as int) as domain_id from part "
        "where p_partkey % 6 not in (select r_regionkey from region)",
    ),
    "name_collisions": (
        colliding_names,
        """with requests as (select p_partkey + case when p_partkey % 2 = 0 then 0 else 10000000 end as id,
  't_' || p_partkey as name from part)
select id, name, 'template' as taken_by from requests where exists
  (select 1 from part where 't_' || p_partkey = name and p_partkey <> id)
union all select id, name, 'table' from requests where name in (select 't_' || s_suppkey from supplier)""",
    ),
    "duplicate_columns": (
        repeated_columns,
        with_views(
            "template_columns",
            "select template_id, column_name, cast(2 as bigint) as n from template_columns "
            "where template_id % 4 = 0 and column_name = 'c_0'",
        ),
    ),
    "duplicate_reviewers": (
        repeated_reviewers,
        "select l_partkey as template_id, 's' || l_suppkey || '@x.test' as reviewer_email, count(*) as n "
        "from lineitem group by 1, 2 having count(*) > 1",
    ),
    "creators_as_reviewers": (
        reviewing_creators,
        with_views(
            "templates template_reviewers",
            "select template_id, upper(reviewer_email) as reviewer_email from template_reviewers "
            "join templates on id = template_id and created_by = reviewer_email",
        ),
    ),
    "template_rule_audit": (
        template_rule_audit,
        with_views(
            "templates",
            """, faulty as (select id, case when id % 11 = 0 then upper(name) when id % 13 = 0 then 't' else name end as name,
    case when id % 17 = 0 then '' else display_name end as display_name, description, write_mode,
    case when id % 19 = 0 then cast(101 as decimal(5,2)) else bad_row_threshold end as bad_row_threshold,
    case when id % 23 = 0 then 'Active' else status end as status, case when id % 29 = 0 then '||' else ',' end as delimiter
  from templates)
select id, 'name' as field, 'identifier' as rule, name as value from faulty
  where not regexp_full_match(name, '[a-z][a-z0-9_]*')
union all select id, 'name', 'length 3-64', name from faulty where length(name) not between 3 and 64
union all select id, 'display_name', 'length 3-100', display_name from faulty
  where length(display_name) not between 3 and 100
union all select id, 'description', 'length 0-500', description from faulty where length(description) > 500
union all select id, 'delimiter', 'length 0-1', delimiter from faulty where length(delimiter) > 1
union all select id, 'bad_row_threshold', 'between 0 and 100', cast(bad_row_threshold as varchar) from faulty
  where bad_row_threshold not between 0 and 100
union all select id, 'status', 'allowed value', status from faulty where status = 'Active'""",
        ),
    ),
    "column_rule_audit": (
        column_rule_audit,
        with_views(
            "template_columns",
            "select template_id || '/' || column_name as id, 'data_type' as field, 'allowed value' as rule, "
            "'VARCHAR' as value from template_columns where template_id % 9 = 0",
        ),
    ),
    "reviewer_rule_audit": (
        reviewer_rule_audit,
        with_views(
            "template_reviewers",
            """, faulty as (select template_id || '/' || reviewer_email as id, case when template_id % 7 = 0
    then replace(reviewer_email, '@', ' at ') else reviewer_email end as reviewer_email, template_id, reviewer_type from template_reviewers)
select id, 'reviewer_email' as field, 'email' as rule, reviewer_email as value from faulty where template_id % 7 = 0
union all select id, 'reviewer_name', 'length 1-100', null from faulty where template_id % 5 = 0
union all select id, 'reviewer_type', 'allowed value', 'observer' from faulty where template_id % 11 = 0""",
        ),
    ),
    "approval_rule_audit": (
        approval_rule_audit,
        with_views(
            "template_approvals",
            "select approval_token as id, 'action' as field, 'allowed value' as rule, 'maybe' as value "
            "from template_approvals where template_id % 7 = 0 union all select approval_token, 'comment', "
            "'length 0-500', repeat('x', 501) from template_approvals where template_id % 5 = 0",
        ),
    ),
    "decision_rule_audit": (
        decision_rule_audit,
        with_views(
            "decisions",
            "select decision_id as id, 'decision' as field, 'allowed value' as rule, "
            "case when decision_id % 7 = 0 then null else 'APPROVE' end as value from decisions "
            "where decision_id % 7 = 0 or decision_id % 11 = 0 union all select decision_id, 'comment', "
            "'length 0-500', repeat('x', 501) from decisions where decision_id % 5 = 0",
        ),
    ),
    "history_rule_audit": (
        history_rule_audit,
        with_views(
            "upload_history",
            "select id, 'status' as field, 'allowed value' as rule, 'success' as value from upload_history where id % 7 = 0",
        ),
    ),
    "error_rule_audit": (
        error_rule_audit,
        "select l_orderkey || '/' || l_linenumber as id, 'error_type' as field, 'allowed value' as rule, "
        "case when l_partkey % 7 = 5 then 'ODD' end as value from lineitem where l_partkey % 7 in (5, 6)",
    ),
    "missing_target_tables": (
        missing_target_tables,
        with_views(
            "templates",
            "select uc_table_name as table_name from templates where uc_table_name not in "
            "(select 't_' || s_suppkey from supplier)",
        ),
    ),
    "integrity_audit": (
        integrity,
        with_views(
            "domains templates template_columns template_reviewers template_approvals upload_history",
            """select 'orphan' as "check", 'upload_validation_errors' as table_name, 'upload_id' as key_columns,
  cast(upload_id as varchar) as key_value, count(*) as n
  from (select case when l_linenumber = 7 then -l_orderkey else l_orderkey end as upload_id from lineitem)
  where upload_id not in (select id from upload_history) group by upload_id
union all select 'orphan' as "check", 'upload_history' as table_name, 'template_id' as key_columns,
  cast(template_id as varchar) as key_value, count(*) as n from upload_history
  where template_id not in (select id from templates) group by template_id
union all select 'orphan', 'templates', 'domain_id', cast(domain_id as varchar), count(*) from templates
  where domain_id not in (select id from domains) group by domain_id
union all select 'orphan', 'templates', 'parent_template_id', cast(parent_template_id as varchar), count(*) from templates
  where parent_template_id not in (select id from templates) group by parent_template_id
union all select 'orphan', 'template_columns', 'template_id', cast(template_id as varchar), count(*)
  from template_columns where template_id not in (select id from templates) group by template_id
union all select 'orphan', 'template_reviewers', 'template_id', cast(template_id as varchar), count(*)
  from template_reviewers where template_id not in (select id from templates) group by template_id
union all select 'orphan', 'template_approvals', 'template_id', cast(template_id as varchar), count(*)
  from template_approvals where template_id not in (select id from templates) group by template_id
union all select 'not unique', 'domains', 'name', name, count(*) from domains group by name having count(*) > 1
union all select 'not unique', 'templates', 'fully_qualified_name', fully_qualified_name, count(*) from templates
  group by fully_qualified_name having count(*) > 1
union all select 'not unique', 'template_approvals', 'approval_token', approval_token, count(*)
  from template_approvals group by approval_token having count(*) > 1""",
        ),
    ),
    "template_patch": (
        patched_templates,
        with_views(
            "templates patches",
            """select t.id, name, display_name,
  case when status = 'Draft' and has_description then p.description else t.description end as description, domain_id,
  uc_table_name, fully_qualified_name,
  case when status = 'Draft' and has_write_mode then p.write_mode else t.write_mode end as write_mode,
  bad_row_threshold, bad_row_action, reader_group, status, version, parent_template_id, created_by, created_at
from templates as t left join patches as p on p.id = t.id""",
        ),
    ),
    "patch_outcomes": (
        patch_outcomes,
        with_views(
            "templates patches",
            "select p.id, case when status = 'Draft' then 'ok' else 'not_draft' end as outcome "
            "from patches as p join templates as t on t.id = p.id",
        ),
    ),
    "replaced_columns": (
        replaced_columns,
        with_views(
            "templates template_columns",
            f""",{_VALID_LISTS},
gone as (select template_id from outcomes where outcome = 'ok')
select * from template_columns where template_id not in (select template_id from gone)
union all by name select template_id, 'code' as column_name, 'STRING' as data_type, cast(null as varchar) as description,
  true as is_included, false as is_pii, true as is_nullable, false as is_unique, 0 as column_order from gone
union all by name select template_id, 'amount' as column_name, 'DOUBLE' as data_type,
  cast(null as varchar) as description, true as is_included, false as is_pii, true as is_nullable,
  false as is_unique, 1 as column_order from gone""",
        ),
    ),
    "replaced_column_outcomes": (
        replaced_column_outcomes,
        with_views("templates", f",{_VALID_LISTS} select * from outcomes"),
    ),
    "replaced_reviewers": (
        replaced_reviewers,
        with_views(
            "templates template_reviewers",
            """, gone as (select p_partkey as template_id from part join templates on id = p_partkey
  where status = 'Draft' and p_partkey % 3 % 2 <> 0)
select * from template_reviewers where template_id not in (select template_id from gone)
union all select template_id, 's' || (template_id % 20 + template_id % 3 % 2) || '@x.test', 'required' from gone
union all select template_id, 'extra@x.test', 'optional' from gone""",
        ),
    ),
    "delete_outcomes": (
        delete_outcomes,
        with_views("templates upload_history", f",{_DELETE} select * from outcomes"),
    ),
    "rows_after_delete": (
        remaining_rows,
        with_views(
            "templates template_columns template_reviewers template_approvals upload_history",
            f""",{_DELETE}
select 'templates' as table_name, id as template_id, count(*) as n from templates
  where id not in (select id from gone) group by id
union all select 'template_columns', template_id, count(*) from template_columns
  where template_id not in (select id from gone) group by template_id
union all select 'template_reviewers', template_id, count(*) from template_reviewers
  where template_id not in (select id from gone) group by template_id
union all select 'template_approvals', template_id, count(*) from template_approvals
  where template_id not in (select id from gone) group by template_id""",
        ),
    ),
    "single_child_delete": (
        single_deletions,
        with_views(
            "templates template_columns",
            "select * from template_columns where not (column_name = 'c_1' "
            "and template_id in (select id from templates where status = 'Draft'))",
        ),
    ),
    "new_versions": (
        cloned_versions,
        with_views(
            "templates",
            "select id + 10000000 as id, name, display_name, description, domain_id, uc_table_name, "
            "fully_qualified_name, write_mode, bad_row_threshold, bad_row_action, reader_group, 'Draft' as status, "
            "version + 1 as version, coalesce(parent_template_id, id) as parent_template_id, created_by, "
            "cast('2024-02-01 00:00:00' as timestamp) as created_at from templates where status = 'Approved'",
        ),
    ),
    "latest_versions": (
        lambda s, d: registry.latest_versions(view(s, d, "templates")),
        with_views(
            "templates",
            "select * exclude (rn) from (select *, coalesce(parent_template_id, id) as root_id, row_number() over "
            "(partition by coalesce(parent_template_id, id) order by version desc, id desc) as rn from templates) as x "
            "where rn = 1",
        ),
    ),
    "deprecated_versions": (
        lambda s, d: registry.deprecate_older(view(s, d, "templates")).select("id", "status"),
        with_views(
            "templates",
            """select id, case when status = 'Approved' and version < (select max(version) from templates as o
    where o.status = 'Approved' and coalesce(o.parent_template_id, o.id) = coalesce(t.parent_template_id, t.id))
  then 'Deprecated' else status end as status from templates as t""",
        ),
    ),
    "schema_names": (
        lambda s, d: table(s, d, "nation").select("n_name", schema_name("n_name").alias("uc_schema_name")).unionByName(
            table(s, d, "part").select(F.col("p_name").alias("n_name"), schema_name("p_name").alias("uc_schema_name"))
        ),
        "select n_name, lower(regexp_replace(trim(n_name), '[^A-Za-z0-9]+', '_', 'g')) as uc_schema_name "
        "from (select n_name from nation union all select p_name from part) as n",
    ),
    "ddl_plan": (
        ddl_texts,
        with_views(
            "templates template_columns",
            """, clauses as (select template_id, column_order, column_name || ' ' || data_type
    || case when is_nullable then '' else ' NOT NULL' end
    || case when is_pii and coalesce(description, '') <> ''
        then ' COMMENT ''PII - masked | ' || replace(description, '''', '''''') || ''''
      when is_pii then ' COMMENT ''PII - masked''' when coalesce(description, '') <> ''
        then ' COMMENT ''' || replace(description, '''', '''''') || '''' else '' end as clause
  from template_columns where is_included)
select template_id, 'CREATE TABLE IF NOT EXISTS ' || any_value(fully_qualified_name) || ' (' || chr(10) || '    '
  || string_agg(clause, ',' || chr(10) || '    ' order by column_order)
  || ',' || chr(10) || '    uploaded_by STRING,' || chr(10) || '    uploaded_at TIMESTAMP,' || chr(10)
  || '    source_file STRING' || chr(10) || ')' || chr(10) || 'USING DELTA' || chr(10)
  || 'COMMENT ''' || replace(any_value(description), '''', '''''') || '''' as ddl
from clauses join templates on id = template_id group by template_id""",
        ),
    ),
    "target_columns": (
        target_column_list,
        with_views("template_columns", _TARGET_COLUMNS + "select * from targets"),
    ),
    "provisioned_columns": (
        provisioned_columns,
        with_views(
            "templates template_columns",
            _TARGET_COLUMNS
            + """select uc_table_name as table_name, position, column_name, case data_type when 'INTEGER' then 'int'
    when 'DECIMAL' then 'decimal(10,0)' else lower(data_type) end as data_type, comment
  from targets join templates on id = template_id where status = 'Pending DDL'""",
        ),
    ),
    "masked_text": (
        masked_documents,
        "select doc_id, repeat('*', cast(least(length(case when doc_id % 3 <> 0 then source end), 8) as int)) as masked, "
        "repeat('*', cast(least(length(lang), 8) as int)) as short, case when doc_id % 2 = 0 then text "
        "else repeat('*', cast(least(length(text), 8) as int)) end as shown "
        "from documents",
    ),
    "masked_projection": (
        masked_parts,
        "select p_partkey, repeat('*', cast(least(length(p_name), 8) as int)) as p_name, "
        "repeat('*', cast(least(length(cast(p_size as varchar)), 8) as int)) as p_size, p_brand from part",
    ),
    "grant_plan": (
        grants,
        with_views(
            "templates domains principals",
            """, grouped as (select t.id as template_id, fully_qualified_name, uc_schema_name, reader_group,
    case when group_name is null then 'skipped' else 'apply' end as action
  from templates as t join domains as d on d.id = t.domain_id left join principals on group_name = reader_group
  where reader_group <> '')
select template_id, 1 as seq, 'GRANT USE CATALOG ON CATALOG main TO `' || reader_group || '`' as statement, action
  from grouped
union all select template_id, 2, 'GRANT USE SCHEMA ON SCHEMA main.' || uc_schema_name || ' TO `' || reader_group || '`',
  action from grouped
union all select template_id, 3, 'GRANT SELECT ON TABLE ' || fully_qualified_name || ' TO `' || reader_group || '`',
  action from grouped""",
        ),
    ),
}
