"""Template registry: queries, audits and set-based maintenance.

Changing operators return new frames (and the outcome of each request); storing them is
left to the caller. Sides are joined without hints: registry tables are read from files,
so Catalyst knows their size and chooses.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicegate import model

# ---------------------------------------------------------------------------
# Queries
# ---------------------------------------------------------------------------


def search_templates(
    templates: DataFrame,
    status: str | None = None,
    domain_id=None,
    created_by: str | None = None,
    search: str | None = None,
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """One page of templates, newest first; filters are AND'ed, `search` matches part of
    the name or display name in any case."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be 1..200 and offset not negative")
    for name, value in {"status": status, "domain_id": domain_id, "created_by": created_by}.items():
        if value is not None:
            templates = templates.filter(F.col(name) == value)
    if search:
        pattern = f"%{search}%"
        templates = templates.filter(F.col("name").ilike(pattern) | F.col("display_name").ilike(pattern))
    return templates.orderBy(F.col("created_at").desc(), "id").offset(offset).limit(limit)


def list_domains(domains: DataFrame) -> DataFrame:
    return domains.orderBy("name")


def list_columns(columns: DataFrame, template_id) -> DataFrame:
    return columns.filter(F.col("template_id") == template_id).orderBy("column_order")


def list_reviewers(reviewers: DataFrame, template_id) -> DataFrame:
    return reviewers.filter(F.col("template_id") == template_id).orderBy("reviewer_email")


def get_template(templates: DataFrame, template_id):
    """The template as a Row; a missing one is an error."""
    row = templates.filter(F.col("id") == template_id).first()
    if row is None:
        raise LookupError(f"template not found: {template_id}")
    return row


def lookup(requests: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """Bulk form of the point lookup: every requested key with `found`."""
    there = table.select(key, F.lit(True).alias("_found"))
    return requests.select(key).distinct().join(there, key, "left").select(
        key, F.coalesce("_found", F.lit(False)).alias("found")
    )


def template_configs(templates: DataFrame, domains: DataFrame, columns: DataFrame, catalog: str) -> DataFrame:
    """Template, its domain's schema and its ordered columns, nested, for every template
    with a domain. The list of a template is as long as its table is wide."""
    fields = ["column_order", *[c for c in columns.columns if c not in ("template_id", "column_order", "description")]]
    nested = columns.groupBy("template_id").agg(
        F.sort_array(
            F.collect_list(F.struct(*fields, F.coalesce("description", F.lit("")).alias("description")))
        ).alias("columns")
    )
    schemas = domains.select(F.col("id").alias("domain_id"), "uc_schema_name")
    head = templates.select(
        F.col("id").alias("template_id"),
        "domain_id",
        F.col("uc_table_name").alias("table"),
        "fully_qualified_name",
        F.coalesce("description", F.lit("")).alias("description"),
        "reader_group",
    )
    return (
        head.join(schemas, "domain_id")
        .join(nested, "template_id", "left")
        .select(
            "template_id",
            F.lit(catalog).alias("catalog"),
            F.col("uc_schema_name").alias("schema"),
            "table",
            "fully_qualified_name",
            "description",
            "reader_group",
            F.coalesce("columns", F.array().cast(nested.schema["columns"].dataType)).alias("columns"),
        )
    )


def load_config(configs: DataFrame, template_id) -> model.TemplateConfig:
    """One template's nested row as a driver-side config; a missing one is an error."""
    row = configs.filter(F.col("template_id") == template_id).first()
    if row is None:
        raise LookupError(f"template not found: {template_id}")
    return _config(row)


def load_configs(configs: DataFrame) -> Iterator[model.TemplateConfig]:
    """All nested rows as configs, a partition of them at a time on the driver."""
    return (_config(row) for row in configs.toLocalIterator())


def _config(row) -> model.TemplateConfig:
    known = set(model.TemplateConfig.__dataclass_fields__) - {"columns", "extra"}
    settings = {k: v for k, v in row.asDict().items() if k in known}
    return model.TemplateConfig.from_rows(row["columns"], **settings)


def uploadable_templates(templates: DataFrame, domains: DataFrame) -> DataFrame:
    """Approved templates with the name of their domain."""
    names = domains.select(F.col("id").alias("domain_id"), F.col("name").alias("domain_name"))
    return (
        templates.filter(F.col("status") == "Approved")
        .join(names, "domain_id")
        .select("domain_name", "id", "name", "display_name", "version")
    )


# ---------------------------------------------------------------------------
# Registration and checks
# ---------------------------------------------------------------------------


def register(requests: DataFrame, domains: DataFrame, catalog: str) -> DataFrame:
    """New Draft templates from requests (id, name, display_name, description, domain_id,
    created_by, requested_at); requests for unknown domains are left out, see
    `unknown_domains`."""
    schemas = domains.select(F.col("id").alias("domain_id"), "uc_schema_name")
    stamp = F.col("requested_at")
    text = "string"
    return requests.join(schemas, "domain_id").select(
        "id",
        "name",
        "display_name",
        "description",
        "domain_id",
        F.col("name").alias("uc_table_name"),
        F.concat_ws(".", F.lit(catalog), "uc_schema_name", "name").alias("fully_qualified_name"),
        F.lit("csv").alias("file_format"),
        F.lit(",").alias("delimiter"),
        F.lit("UTF-8").alias("encoding"),
        F.lit("append").alias("write_mode"),
        F.lit("5.00").cast("decimal(5,2)").alias("bad_row_threshold"),
        F.lit("drop").alias("bad_row_action"),
        F.lit(None).cast(text).alias("reader_group"),
        F.lit("Draft").alias("status"),
        F.lit(1).alias("version"),
        F.lit(None).cast(requests.schema["id"].dataType).alias("parent_template_id"),
        "created_by",
        stamp.alias("created_at"),
    )


def unknown_domains(requests: DataFrame, domains: DataFrame) -> DataFrame:
    return requests.join(domains.select(F.col("id").alias("domain_id")), "domain_id", "left_anti")


def name_collisions(
    requests: DataFrame, templates: DataFrame, existing_tables: DataFrame | None = None
) -> DataFrame:
    """Requests (id, name) whose name another template, or a table of the catalog, already
    bears: (id, name, taken_by). A template never collides with its own lineage
    (`root_id`, where both frames have it) nor with itself. Requests of one batch collide
    with each other in the same way (`taken_by` is `request`): none of them is first."""
    same_line = "root_id" in templates.columns and "root_id" in requests.columns
    own = "root_id" if same_line else "id"
    # One row per name is enough to decide: two different owners, or one that is not ours.
    owners = templates.groupBy("name").agg(F.min(own).alias("_low"), F.max(own).alias("_high"))
    taken = (
        requests.join(owners, "name")
        .filter((F.col("_low") != F.col(own)) | (F.col("_high") != F.col(own)))
        .select("id", "name", F.lit("template").alias("taken_by"))
    )
    several = requests.groupBy("name").agg(F.min(own).alias("_low"), F.max(own).alias("_high")).filter("_low <> _high")
    taken = taken.unionByName(
        requests.join(several, "name", "left_semi").select("id", "name", F.lit("request").alias("taken_by"))
    )
    if existing_tables is not None:
        tables = existing_tables.select(F.col("table_name").alias("name")).distinct()
        taken = taken.unionByName(
            requests.join(tables, "name", "left_semi").select("id", "name", F.lit("table").alias("taken_by"))
        )
    return taken


def duplicates_in_list(rows: DataFrame, parent: str, key: str, ignore_case: bool = False) -> DataFrame:
    """Keys that occur more than once below one parent: (parent, key, n)."""
    value = F.lower(F.col(key)) if ignore_case else F.col(key)
    return (
        rows.groupBy(parent, value.alias(key)).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    )


def duplicate_columns(columns: DataFrame) -> DataFrame:
    return duplicates_in_list(columns, "template_id", "column_name")


def duplicate_reviewers(reviewers: DataFrame) -> DataFrame:
    return duplicates_in_list(reviewers, "template_id", "reviewer_email", ignore_case=True)


def creators_as_reviewers(reviewers: DataFrame, templates: DataFrame) -> DataFrame:
    """Reviewer rows that name the creator of their template, in any case."""
    creators = templates.select(F.col("id").alias("template_id"), F.lower("created_by").alias("_email"))
    return (
        reviewers.withColumn("_email", F.lower("reviewer_email"))
        .join(creators, ["template_id", "_email"], "left_semi")
        .select("template_id", "reviewer_email")
    )


# ---------------------------------------------------------------------------
# Audits
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class FieldRule:
    """`valid` is a predicate on the field; NULL fields break only `required` rules."""

    field: str
    rule: str
    valid: Column
    required: bool = False

    @property
    def broken(self) -> Column:
        value = F.col(self.field)
        if self.required:
            return value.isNull() | ~F.coalesce(self.valid, F.lit(False))
        return value.isNotNull() & ~F.coalesce(self.valid, F.lit(False))


def _identifier(name: str) -> list[FieldRule]:
    return [
        FieldRule(name, "identifier", F.col(name).rlike(model.IDENTIFIER_PATTERN), True),
        FieldRule(name, "length 3-64", F.length(name).between(3, 64)),
    ]


def _length(name: str, low: int, high: int, required: bool = False) -> FieldRule:
    return FieldRule(name, f"length {low}-{high}", F.length(name).between(low, high), required)


def _one_of(name: str, values: Sequence[str], required: bool = True) -> FieldRule:
    return FieldRule(name, "allowed value", F.col(name).isin(*values), required)


def registry_rules(table: str) -> list[FieldRule]:
    """Field rules of a registry table or of a request payload (`decisions`)."""
    if table == "templates":
        return [
            *_identifier("name"),
            _length("display_name", 3, 100, True),
            _length("description", 0, 500),
            _one_of("file_format", model.FILE_FORMATS),
            _length("delimiter", 0, 1),
            _length("encoding", 0, 20),
            _one_of("write_mode", model.WRITE_MODES),
            FieldRule("bad_row_threshold", "between 0 and 100", F.col("bad_row_threshold").between(0, 100), True),
            _one_of("bad_row_action", model.BAD_ROW_ACTIONS),
            _length("reader_group", 0, 255),
            _one_of("status", model.TEMPLATE_STATUSES),
            FieldRule("version", "at least 1", F.col("version") >= 1, True),
        ]
    if table == "template_columns":
        return [
            *_identifier("column_name"),
            _length("display_name", 0, 100),
            _one_of("data_type", model.DATA_TYPES),
            _length("description", 0, 500),
        ]
    if table == "template_reviewers":
        return [
            FieldRule("reviewer_email", "email", F.col("reviewer_email").rlike("^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$"), True),
            _length("reviewer_name", 1, 100, True),
            _one_of("reviewer_type", model.REVIEWER_TYPES),
        ]
    if table == "template_approvals":
        return [_one_of("action", model.APPROVAL_ACTIONS, False), _length("comment", 0, 500)]
    if table == "decisions":
        return [_one_of("decision", model.DECISIONS), _length("comment", 0, 500)]
    if table == "upload_history":
        return [_one_of("status", model.UPLOAD_STATUSES)]
    if table == "upload_validation_errors":
        return [_one_of("error_type", model.ERROR_TYPES)]
    raise ValueError(f"no rules for {table!r}")


def audit_rules(df: DataFrame, rules: Sequence[FieldRule], key: str = "id", partial: bool = False) -> DataFrame:
    """Broken rules as (key, field, rule, value); good rows leave at one filter. A rule on
    a field that the frame lacks is an error, unless `partial` says that the frame is a
    selection of fields: then only its fields are judged."""
    usable = [r for r in rules if r.field in df.columns]
    absent = sorted({r.field for r in rules} - set(df.columns))
    if absent and not partial:
        raise ValueError(f"the frame lacks fields that have rules: {absent}")
    if not usable:
        raise ValueError("none of the rules applies to this frame")
    any_broken = usable[0].broken
    for r in usable[1:]:
        any_broken = any_broken | r.broken
    entries = [
        F.when(
            r.broken,
            F.struct(
                F.lit(r.field).alias("field"), F.lit(r.rule).alias("rule"), F.col(r.field).cast("string").alias("value")
            ),
        )
        for r in usable
    ]
    return (
        df.filter(any_broken)
        .select(key, F.explode(F.array(*entries)).alias("e"))
        .filter(F.col("e").isNotNull())
        .select(key, "e.field", "e.rule", "e.value")
    )


def integrity_audit(tables: Mapping[str, DataFrame], partial: bool = False) -> DataFrame:
    """Orphaned foreign keys and repeated unique keys of the registry's tables:
    (check, table_name, key_columns, key_value, n). Every table is read once for all its keys
    and once more, ids only, as a parent; keys are counted together before they are joined,
    so a parent with many children is one row. A table or a key column that is
    not there is an error, unless `partial` allows to check what there is."""
    needed = [(child, (column,)) for child, column, *_ in model.FOREIGN_KEYS] + list(model.UNIQUE_KEYS)
    absent = [t for t in model.REGISTRY_SCHEMAS if t not in tables]
    absent += [f"{t}.{c}" for t, key in needed if t in tables for c in key if c not in tables[t].columns]
    if absent and not partial:
        raise ValueError(f"can't be checked without {sorted(set(absent))}")
    keys = [
        ("orphan", child, (column,), parent)
        for child, column, parent, _ in model.FOREIGN_KEYS
        if child in tables and parent in tables and column in tables[child].columns
    ]
    keys += [
        ("not unique", table, tuple(key), None)
        for table, key in model.UNIQUE_KEYS
        if table in tables and set(key) <= set(tables[table].columns)
    ]
    cells, parents = [], []
    for table, rows in tables.items():
        # All keys of a table in one look at it, as (number of the key, its values as text).
        own = [
            F.struct(F.lit(number).alias("key"), F.array(*[F.col(c).cast("string") for c in columns]).alias("value"))
            for number, (_, name, columns, _) in enumerate(keys)
            if name == table
        ]
        if own:
            cells.append(rows.select(F.inline(F.array(*own))))
        asked = [F.lit(number) for number, (*_, parent) in enumerate(keys) if parent == table]
        if asked:
            parents.append(rows.select(F.explode(F.array(*asked)).alias("key"), F.array(F.col("id").cast("string")).alias("value")))
    used = _stacked(cells).groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))
    refers = F.col("key").isin([number for number, (*_, parent) in enumerate(keys) if parent is not None])
    orphans = used.filter(refers & F.col("value")[0].isNotNull())
    if parents:
        orphans = orphans.join(_stacked(parents), ["key", "value"], "left_anti")
    named = F.array(
        *[F.struct(F.lit(check).alias("check"), F.lit(t).alias("table_name"), F.lit(",".join(c)).alias("key_columns")) for check, t, c, _ in keys]
    )
    return orphans.unionByName(used.filter(~refers & (F.col("n") > 1))).select(
        named[F.col("key")].alias("k"), F.concat_ws(",", "value").alias("key_value"), "n"
    ).select("k.check", "k.table_name", "k.key_columns", "key_value", "n")


def _stacked(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for more in frames[1:]:
        whole = whole.unionByName(more)
    return whole


# ---------------------------------------------------------------------------
# Maintenance
# ---------------------------------------------------------------------------


def patch(templates: DataFrame, changes: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Templates after partial updates. `changes` holds id, each field and `has_<field>`:
    a supplied NULL replaces, an absent field does not. Only Drafts change."""
    renamed = changes.select(
        "id", F.lit(True).alias("_hit"), *[F.col(f).alias(f"_new_{f}") for f in fields], *[f"has_{f}" for f in fields]
    )
    joined = templates.join(renamed, "id", "left")
    applies = F.coalesce(F.col("_hit") & (F.col("status") == "Draft"), F.lit(False))
    return joined.select(
        *[
            F.when(applies & F.col(f"has_{c}"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else c
            for c in templates.columns
        ]
    )


def _draft_requests(requests: DataFrame, templates: DataFrame, key: str) -> DataFrame:
    """Outcome of requests that need a Draft template: ok, not_draft or not_found."""
    states = templates.select(F.col("id").alias(key), F.col("status").alias("_status"))
    outcome = (
        F.when(F.col("_status").isNull(), "not_found").when(F.col("_status") != "Draft", "not_draft").otherwise("ok")
    )
    return requests.join(states, key, "left").withColumn("outcome", outcome).drop("_status")


def patch_outcomes(templates: DataFrame, changes: DataFrame) -> DataFrame:
    return _draft_requests(changes.select("id"), templates, "id")


def replace_children(children: DataFrame, templates: DataFrame, lists: DataFrame, key: str) -> DataFrame:
    """Child rows after whole lists were replaced.

    `lists`: template_id and `items`, an array of structs with the fields of `children`
    (without template_id and column_order). Replaced lists get column_order from their
    position where the table has it; e-mails are stored in lower case. Requests that
    `list_outcomes` rejects change nothing.
    """
    accepted = list_outcomes(templates, lists, key).filter(F.col("outcome") == "ok").select("template_id")
    items = lists.join(accepted, "template_id", "left_semi").select(
        "template_id", F.posexplode("items").alias("column_order", "item")
    )
    fields = []
    for c in children.columns:
        if c in ("template_id", "column_order"):
            fields.append(F.col(c))
        elif c == "reviewer_email":
            fields.append(F.lower("item.reviewer_email").alias(c))
        else:
            fields.append(F.col(f"item.{c}").alias(c))
    kept = children.join(accepted, "template_id", "left_anti").select(*children.columns)
    return kept.unionByName(items.select(*fields))


def list_outcomes(templates: DataFrame, lists: DataFrame, key: str) -> DataFrame:
    """Outcome per list request: ok, not_found, not_draft, empty, creator or duplicate.
    `key` is the field that must be unique; e-mails compare in lower case, and the
    template's creator may not be a reviewer."""
    emails = key == "reviewer_email"
    states = templates.select(
        F.col("id").alias("template_id"), F.col("status").alias("_status"), F.lower("created_by").alias("_creator")
    )

    def value(item: Column) -> Column:
        return F.lower(item[key]) if emails else item[key]

    values = F.transform("items", value)
    outcome = (
        F.when(F.col("_status").isNull(), "not_found")
        .when(F.col("_status") != "Draft", "not_draft")
        .when(F.coalesce(F.size("items"), F.lit(0)) <= 0, "empty")
    )
    if emails:
        outcome = outcome.when(F.array_contains(values, F.col("_creator")), "creator")
    outcome = outcome.when(F.size(F.array_distinct(values)) < F.size(values), "duplicate").otherwise("ok")
    return lists.join(states, "template_id", "left").select("template_id", outcome.alias("outcome"))


def delete_outcomes(templates: DataFrame, requests: DataFrame, uploads: DataFrame) -> DataFrame:
    """Outcome per template to delete (id): ok, not_found, not_draft, has_uploads, or
    is_parent when other templates name it as their original."""
    used = uploads.select(F.col("template_id").alias("id"), F.lit(True).alias("_used")).distinct()
    children = (
        templates.filter(F.col("parent_template_id").isNotNull())
        .select(F.col("parent_template_id").alias("id"), F.lit(True).alias("_parent"))
        .distinct()
    )
    checked = (
        _draft_requests(requests.select("id").distinct(), templates, "id")
        .join(used, "id", "left")
        .join(children, "id", "left")
    )
    return checked.select(
        "id",
        F.when(F.col("outcome") != "ok", F.col("outcome"))
        .when(F.col("_used"), "has_uploads")
        .when(F.col("_parent"), "is_parent")
        .otherwise("ok")
        .alias("outcome"),
    )


def delete_templates(
    tables: Mapping[str, DataFrame], requests: DataFrame
) -> dict[str, DataFrame]:
    """The registry tables after deleting templates: accepted ones go with their columns,
    reviewers and approvals."""
    gone = (
        delete_outcomes(tables["templates"], requests, tables["upload_history"])
        .filter(F.col("outcome") == "ok")
        .select(F.col("id").alias("template_id"))
    )
    left = {"templates": tables["templates"].join(gone.toDF("id"), "id", "left_anti")}
    for child, column, parent, rule in model.FOREIGN_KEYS:
        if parent == "templates" and rule == "cascade" and child in tables:
            left[child] = tables[child].join(gone.toDF(column), column, "left_anti")
    return left


def delete_children(children: DataFrame, templates: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """Child rows after single deletions (template_id, key) on Draft templates; the order
    of the remaining columns keeps its gaps."""
    allowed = requests.join(
        templates.filter(F.col("status") == "Draft").select(F.col("id").alias("template_id")),
        "template_id",
        "left_semi",
    ).select("template_id", key)
    return children.join(allowed, ["template_id", key], "left_anti")


# ---------------------------------------------------------------------------
# Versions
# ---------------------------------------------------------------------------


def with_root(templates: DataFrame, lineage: DataFrame | None = None) -> DataFrame:
    """Add `root_id`, the original template of the lineage. Versions made here point straight to
    it; for tables in which versions of versions do not, pass `lineage.lineages(templates)`.
    A template without a root, on a cycle, is a lineage of its own."""
    if lineage is None:
        return templates.withColumn("root_id", F.coalesce("parent_template_id", "id"))
    roots = lineage.select("id", F.coalesce("root_id", "id").alias("root_id"))
    return templates.join(roots, "id", "left").select(*templates.columns, F.coalesce("root_id", "parent_template_id").alias("root_id"))


def latest_versions(templates: DataFrame, lineage: DataFrame | None = None) -> DataFrame:
    """Newest version of each lineage, as one aggregate."""
    rooted = with_root(templates, lineage)
    rest = [c for c in rooted.columns if c != "root_id"]
    return (
        rooted.groupBy("root_id")
        .agg(F.max_by(F.struct(*rest), F.struct("version", "id")).alias("t"))
        .select("root_id", *[F.col(f"t.{c}").alias(c) for c in rest])
    )


def new_versions(
    templates: DataFrame, requests: DataFrame, created_at: Column, lineage: DataFrame | None = None
) -> DataFrame:
    """Draft clones of Approved templates, one version up and pointing to the original.
    `requests`: id and new_id. The cloned template stays as it is."""
    approved = with_root(templates, lineage).filter(F.col("status") == "Approved")
    clones = approved.join(requests.select("id", "new_id"), "id")
    replaced = {
        "id": F.col("new_id"),
        "version": F.col("version") + 1,
        "parent_template_id": F.col("root_id"),
        "status": F.lit("Draft"),
        "created_at": created_at,
    }
    return clones.select(*[replaced.get(c, F.col(c)).alias(c) for c in templates.columns])


def deprecate_older(templates: DataFrame, lineage: DataFrame | None = None) -> DataFrame:
    """Once a version is Approved, the Approved versions before it become Deprecated."""
    rooted = with_root(templates, lineage)
    newest = (
        rooted.filter(F.col("status") == "Approved").groupBy("root_id").agg(F.max("version").alias("_approved"))
    )
    older = (F.col("status") == "Approved") & (F.col("version") < F.col("_approved"))
    return rooted.join(newest, "root_id", "left").select(
        *[F.when(older, "Deprecated").otherwise(F.col(c)).alias(c) if c == "status" else c for c in templates.columns]
    )
