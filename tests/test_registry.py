"""Registry queries, audits, maintenance and bootstrap."""

import pytest
from pyspark.sql import functions as F

from sluicegate.model import REGISTRY_SCHEMAS, TemplateConfig
from sluicegate.operators import registry
from sluicegate.sources import bootstrap
from sluicegate.sources.jdbc import jdbc_options

TEMPLATES = (
    "id int, name string, display_name string, description string, domain_id int, status string, version int, "
    "parent_template_id int, created_by string, created_at int, write_mode string"
)


def template(i, name=None, status="Draft", version=1, parent=None, creator="ann@x.test", description="old", domain=1):
    return (i, name or f"t_{i}", f"Table {i}", description, domain, status, version, parent, creator, i, "append")


@pytest.fixture
def templates(spark):
    rows = [template(1), template(2, status="Approved"), template(3, "mapping", "Approved", domain=2), template(4, status="Pending DDL")]
    return spark.createDataFrame(rows, TEMPLATES)


def ids(df):
    return [r.id for r in df.collect()]


def test_search(templates):
    assert ids(registry.search_templates(templates)) == [4, 3, 2, 1]
    assert ids(registry.search_templates(templates, status="Approved")) == [3, 2]
    assert ids(registry.search_templates(templates, status="Approved", domain_id=2)) == [3]
    assert ids(registry.search_templates(templates, search="MAPP")) == [3]
    assert ids(registry.search_templates(templates, search="table 3")) == [3]
    assert ids(registry.search_templates(templates, created_by="nobody")) == []
    assert ids(registry.search_templates(templates, limit=2, offset=1)) == [3, 2]


def test_search_needs_no_full_sort(templates):
    plan = registry.search_templates(templates, limit=2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


@pytest.mark.parametrize("limit, offset", [(0, 0), (201, 0), (1, -1)])
def test_search_bounds(templates, limit, offset):
    with pytest.raises(ValueError):
        registry.search_templates(templates, limit=limit, offset=offset)


def test_point_lookup(templates):
    assert registry.get_template(templates, 3).name == "mapping"
    with pytest.raises(LookupError, match="99"):
        registry.get_template(templates, 99)


def test_config_round_trip(spark):
    head = spark.sql(
        "select 1 as id, 1 as domain_id, 'people' as uc_table_name, 'main.hr.people' as fully_qualified_name, "
        "cast(null as string) as description, 'readers' as reader_group"
    )
    domains = spark.sql("select 1 as id, 'hr' as uc_schema_name")
    columns = spark.createDataFrame(
        [(1, "b", "INTEGER", None, True, False, False, True, 2), (1, "a", "STRING", "x", True, True, True, False, 1)],
        "template_id int, column_name string, data_type string, description string, is_included boolean, "
        "is_pii boolean, is_nullable boolean, is_unique boolean, column_order int",
    )
    cfg = registry.load_config(registry.template_configs(head, domains, columns, "main"), 1)
    assert isinstance(cfg, TemplateConfig)
    assert [c.column_name for c in cfg.columns] == ["a", "b"]
    assert (cfg.columns[1].description, cfg.unique[0].column_name, cfg.fully_qualified_name) == ("", "b", "main.hr.people")
    with pytest.raises(LookupError):
        registry.load_config(registry.template_configs(head, domains, columns, "main"), 2)
    wide = head.unionByName(head.withColumn("id", F.col("id") + 1))
    found = {c.template_id: c for c in registry.load_configs(registry.template_configs(wide, domains, columns, "main"))}
    assert found[1] == cfg and found[2].columns == ()
    assert list(registry.load_configs(registry.template_configs(head.limit(0), domains, columns, "main"))) == []


def test_patch_tells_a_null_from_an_absent_field(spark, templates):
    changes = spark.createDataFrame(
        [(1, True, None, False, "overwrite"), (2, True, "new", True, "overwrite"), (9, True, "new", True, "overwrite")],
        "id int, has_description boolean, description string, has_write_mode boolean, write_mode string",
    )
    found = {r.id: (r.description, r.write_mode) for r in registry.patch(templates, changes, ["description", "write_mode"]).collect()}
    assert found == {1: (None, "append"), 2: ("old", "append"), 3: ("old", "append"), 4: ("old", "append")}
    assert {r.id: r.outcome for r in registry.patch_outcomes(templates, changes).collect()} == {1: "ok", 2: "not_draft", 9: "not_found"}


def test_replaced_lists(spark, templates):
    children = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "c", 0)], "template_id int, column_name string, column_order int")
    lists = spark.createDataFrame(
        [(1, [("x",), ("y",), ("z",)]), (2, [("x",)]), (7, [("x",)])], "template_id int, items array<struct<column_name string>>"
    )
    found = sorted(tuple(r) for r in registry.replace_children(children, templates, lists, "column_name").collect())
    assert found == [(1, "x", 0), (1, "y", 1), (1, "z", 2), (2, "c", 0)]


@pytest.mark.parametrize(
    "items, outcome",
    [
        ([("B@x.test",)], "ok"),
        ([], "empty"),
        (None, "empty"),
        ([("ANN@X.test",)], "creator"),
        ([("b@x.test",), ("B@x.test",)], "duplicate"),
    ],
)
def test_reviewer_lists(spark, templates, items, outcome):
    lists = spark.createDataFrame([(1, items)], "template_id int, items array<struct<reviewer_email string>>")
    assert registry.list_outcomes(templates, lists, "reviewer_email").first().outcome == outcome
    children = spark.createDataFrame([(1, "old@x.test")], "template_id int, reviewer_email string")
    left = {r.reviewer_email for r in registry.replace_children(children, templates, lists, "reviewer_email").collect()}
    assert left == ({"b@x.test"} if outcome == "ok" else {"old@x.test"})


def test_delete_cascades_or_refuses(spark):
    rows = [template(1), template(2), template(3, status="Approved"), template(4), template(5, parent=4, version=2)]
    tables = {
        "templates": spark.createDataFrame(rows, TEMPLATES),
        "template_columns": spark.createDataFrame([(i, "c") for i in range(1, 6)], "template_id int, column_name string"),
        "template_reviewers": spark.createDataFrame([(1, "r"), (2, "r")], "template_id int, reviewer_email string"),
        "template_approvals": spark.createDataFrame([(1, "k")], "template_id int, approval_token string"),
        "upload_history": spark.createDataFrame([(10, 2)], "id int, template_id int"),
    }
    requests = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 9)], "id int")
    outcomes = {r.id: r.outcome for r in registry.delete_outcomes(tables["templates"], requests, tables["upload_history"]).collect()}
    assert outcomes == {1: "ok", 2: "has_uploads", 3: "not_draft", 4: "is_parent", 9: "not_found"}
    left = registry.delete_templates(tables, requests)
    assert sorted(ids(left["templates"])) == [2, 3, 4, 5]
    assert sorted(r.template_id for r in left["template_columns"].collect()) == [2, 3, 4, 5]
    assert [r.template_id for r in left["template_reviewers"].collect()] == [2]
    assert left["template_approvals"].count() == 0


def test_single_delete_keeps_gaps(spark, templates):
    children = spark.createDataFrame([(t, n, o) for t in (1, 2) for o, n in enumerate("abc")], "template_id int, column_name string, column_order int")
    requests = spark.createDataFrame([(1, "b"), (2, "b")], "template_id int, column_name string")
    left = registry.delete_children(children, templates, requests, "column_name")
    assert sorted((r.template_id, r.column_order) for r in left.collect()) == [(1, 0), (1, 2), (2, 0), (2, 1), (2, 2)]


def test_versions(spark):
    rows = [template(1, status="Approved"), template(2, status="Approved", version=2, parent=1), template(3, status="Draft")]
    templates = spark.createDataFrame(rows, TEMPLATES)
    latest = {r.root_id: r.id for r in registry.latest_versions(templates).collect()}
    assert latest == {1: 2, 3: 3}
    requests = spark.createDataFrame([(2, 20), (3, 30)], "id int, new_id int")
    clones = registry.new_versions(templates, requests, F.lit(99)).collect()
    assert [(c.id, c.version, c.parent_template_id, c.status, c.name) for c in clones] == [(20, 3, 1, "Draft", "t_2")]
    assert {r.id: r.status for r in registry.deprecate_older(templates).collect()} == {1: "Deprecated", 2: "Approved", 3: "Draft"}


def test_names_collide_outside_their_lineage(spark):
    rows = [template(1, "a"), template(2, "a", version=2, parent=1), template(3, "b")]
    templates = registry.with_root(spark.createDataFrame(rows, TEMPLATES))
    requests = spark.createDataFrame([(2, "a", 1), (9, "a", 9), (3, "b", 3), (8, "new", 8), (7, "taken", 7)], "id int, name string, root_id int")
    tables = spark.createDataFrame([("taken",), ("taken",)], "table_name string")
    found = registry.name_collisions(requests, templates, tables)
    assert {(r.id, r.taken_by) for r in found.collect()} == {
        (9, "template"),
        (7, "table"),
        (2, "request"),  # 2 and 9 ask for one name in one batch
        (9, "request"),
    }


@pytest.mark.parametrize(
    "table, row, broken",
    [
        ("templates", {"name": "ok_1", "display_name": "Fine"}, set()),
        ("templates", {"name": "1bad"}, {("name", "identifier")}),
        ("templates", {"name": "ab"}, {("name", "length 3-64")}),
        ("templates", {"name": "a" * 65}, {("name", "length 3-64")}),
        ("templates", {"name": None}, {("name", "identifier")}),
        ("templates", {"display_name": "x" * 101}, {("display_name", "length 3-100")}),
        ("templates", {"description": "x" * 501}, {("description", "length 0-500")}),
        ("templates", {"description": None}, set()),
        ("templates", {"file_format": "json"}, {("file_format", "allowed value")}),
        ("templates", {"delimiter": "||"}, {("delimiter", "length 0-1")}),
        ("templates", {"bad_row_threshold": 100.5}, {("bad_row_threshold", "between 0 and 100")}),
        ("templates", {"status": "Active"}, {("status", "allowed value")}),
        ("templates", {"version": 0}, {("version", "at least 1")}),
        ("template_columns", {"data_type": "BIGINT"}, set()),
        ("template_columns", {"data_type": "VARCHAR"}, {("data_type", "allowed value")}),
        ("template_reviewers", {"reviewer_type": "other"}, {("reviewer_type", "allowed value")}),
        ("template_reviewers", {"reviewer_email": "nobody"}, {("reviewer_email", "email")}),
        ("template_approvals", {"action": None}, set()),
        ("template_approvals", {"action": "approve"}, {("action", "allowed value")}),
        ("decisions", {"decision": "approved"}, {("decision", "allowed value")}),
        ("decisions", {"comment": "x" * 501}, {("comment", "length 0-500")}),
        ("upload_history", {"status": "success"}, {("status", "allowed value")}),
        ("upload_validation_errors", {"error_type": "OTHER"}, {("error_type", "allowed value")}),
    ],
)
def test_field_rules(spark, table, row, broken):
    (field, value), *_ = row.items()
    kinds = {"version": "int", "bad_row_threshold": "double"}
    schema = "id int, " + ", ".join(f"{k} {kinds.get(k, 'string')}" for k in row)
    df = spark.createDataFrame([(1, *row.values())], schema)
    assert {(r.field, r.rule) for r in registry.audit_rules(df, registry.registry_rules(table), partial=True).collect()} == broken


def test_rules_on_absent_fields_are_an_error(spark):
    df = spark.createDataFrame([(1, "name")], "id int, name string")
    with pytest.raises(ValueError, match="bad_row_action"):
        registry.audit_rules(df, registry.registry_rules("templates"))


def test_integrity_audit(spark):
    tables = {
        "domains": spark.createDataFrame([(1, "a", "a"), (2, "a", "b")], "id int, name string, uc_schema_name string"),
        "templates": spark.createDataFrame([(1, 1, "x"), (2, 7, "x")], "id int, domain_id int, fully_qualified_name string"),
        "upload_history": spark.createDataFrame([(1, 1), (2, 9), (3, 9)], "id int, template_id int"),
        "upload_validation_errors": spark.createDataFrame([(3,), (4,)], "upload_id int"),
    }
    with pytest.raises(ValueError, match="template_reviewers"):
        registry.integrity_audit(tables)
    assert {tuple(r) for r in registry.integrity_audit(tables, partial=True).collect()} == {
        ("orphan", "templates", "domain_id", "7", 1),
        ("orphan", "upload_history", "template_id", "9", 2),
        ("orphan", "upload_validation_errors", "upload_id", "4", 1),
        ("not unique", "domains", "name", "a", 2),
        ("not unique", "templates", "fully_qualified_name", "x", 2),
    }


def test_bootstrap_and_seed_are_idempotent(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS registry")
    assert bootstrap.missing_registry_tables(spark, "registry").count() == len(REGISTRY_SCHEMAS)
    for _ in range(2):
        assert set(bootstrap.create_registry(spark, "registry")) == set(REGISTRY_SCHEMAS)
    assert bootstrap.missing_registry_tables(spark, "registry").count() == 0
    for _ in range(2):
        new = bootstrap.seed(bootstrap.seed_domains(spark, "2024-01-01"), spark.table("registry.domains"), "name")
        new.select(*spark.table("registry.domains").columns).write.insertInto("registry.domains")
    assert sorted(r.uc_schema_name for r in spark.table("registry.domains").collect()) == [
        "finance", "human_resources", "operations", "sales", "supply_chain",
    ]
    for name, schema in REGISTRY_SCHEMAS.items():
        assert [(f.name, f.dataType) for f in spark.table(f"registry.{name}").schema] == [(f.name, f.dataType) for f in schema]


def test_jdbc_options():
    base = {"url": "jdbc:postgresql://host/db", "user": "u"}
    assert jdbc_options("select 1 as x;", base) == {**base, "dbtable": "(select 1 as x) t"}
    split = jdbc_options("select 1", base, "id", 0, 100, 8)
    assert (split["partitionColumn"], split["lowerBound"], split["upperBound"], split["numPartitions"]) == ("id", "0", "100", "8")
    with pytest.raises(ValueError, match="partitioned"):
        jdbc_options("select 1", base, "id")
    with pytest.raises(ValueError):
        jdbc_options("select 1", {**base, "dbtable": "t"})


def test_config_rejects_bad_settings():
    with pytest.raises(ValueError, match="duplicate"):
        TemplateConfig.from_rows([{"column_name": "a"}, {"column_name": "a"}])
    with pytest.raises(ValueError, match="write mode"):
        TemplateConfig(columns=(), write_mode="merge")
    with pytest.raises(ValueError, match="bad row action"):
        TemplateConfig(columns=(), bad_row_action="ignore")


def test_rounds_of_lineages_broadcast_nothing_by_hint(spark, monkeypatch):
    from sluicegate.operators.lineage import lineages
    from sluicegate.plans import skew

    def refuse(*_):
        raise AssertionError("a side that grows with the templates was measured for a broadcast")

    monkeypatch.setattr(skew, "sized", refuse)
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(40)], "id int, parent_template_id int")
    assert sorted((r.id, r.root_id, r.steps) for r in lineages(chain).collect()) == [(i, 0, i) for i in range(40)]
