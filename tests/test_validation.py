"""Cell rules, verdicts and clean rows on hand-written rows, and their properties."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from sluicegate.functions.cells import castable, typed
from sluicegate.model import ColumnConfig, TemplateConfig, spark_type
from sluicegate.operators import gates, history, publish, validate
from sluicegate.plans import skew

BAD = "\N{REPLACEMENT CHARACTER}"
CONFIG = TemplateConfig(
    columns=(
        ColumnConfig("code", "STRING", is_nullable=False, is_unique=True, column_order=0),
        ColumnConfig("amount", "INTEGER", is_nullable=False, column_order=1),
        ColumnConfig("day", "DATE", column_order=2),
        ColumnConfig("skipped", "INTEGER", is_included=False, is_nullable=False, is_unique=True, column_order=3),
        ColumnConfig("alias", "STRING", is_unique=True, column_order=4),
    ),
    template_id="t",
)
SCHEMA = "upload_id string, row_number long, code string, amount string, day string, skipped string, alias string, _ragged string"
ROWS = [
    ("u1", 1, "a", "1", "2024-01-05", "x", "p", None),
    ("u1", 2, " a ", "2", None, "x", None, None),  # trimmed duplicate of row 1
    ("u1", 3, "01", "x1", "2024-13-45", "x", "", None),
    ("u1", 4, "1", "", "", "x", "  ", None),
    ("u1", 5, "   ", "12.0", "2024-1-5", "x", "q", None),
    ("u1", 6, f"z{BAD}", "3", f"2024-01-05 {BAD}", "x", f"{BAD}", None),
    ("u1", 7, f"y{BAD}", "3", None, "x", f"{BAD}", None),
    ("u1", 8, "a", "9", None, "x", None, "a,9"),  # ragged
    ("u2", 1, "a", "1", None, None, None, None),  # other upload, no duplicate
]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_error_report(rows, rows_of):
    found = rows_of(
        validate.validate(rows, CONFIG), "upload_id", "row_number", "column_name", "error_type", "raw_value"
    )
    assert found == sorted(
        [
            ("u1", 1, "code", "UNIQUE", "a"),
            ("u1", 2, "code", "UNIQUE", " a "),
            ("u1", 3, "amount", "TYPE_MISMATCH", "x1"),
            ("u1", 3, "day", "TYPE_MISMATCH", "2024-13-45"),
            ("u1", 4, "amount", "NOT_NULL", ""),
            ("u1", 5, "code", "NOT_NULL", "   "),
            ("u1", 5, "amount", "TYPE_MISMATCH", "12.0"),
            ("u1", 6, "code", "ENCODING_ERROR", f"z{BAD}"),
            ("u1", 6, "day", "ENCODING_ERROR", f"2024-01-05 {BAD}"),
            ("u1", 6, "alias", "ENCODING_ERROR", BAD),
            ("u1", 7, "code", "ENCODING_ERROR", f"y{BAD}"),
            ("u1", 7, "alias", "ENCODING_ERROR", BAD),
            ("u1", 8, "_row", "SCHEMA_MISMATCH", "a,9"),
        ],
        key=repr,
    )


def test_report_does_not_depend_on_partitioning(rows, rows_of):
    assert rows_of(validate.validate(rows.repartition(7), CONFIG)) == rows_of(validate.validate(rows.coalesce(1), CONFIG))


def test_bad_row_test_agrees_with_the_rules(spark):
    """Every probe in a required and an optional column of every type."""
    kinds = ["STRING", "INTEGER", "BIGINT", "DOUBLE", "DECIMAL", "DECIMAL(12,2)", "BOOLEAN", "DATE", "TIMESTAMP"]
    probes = [
        None, "", "  ", "12", " 12 ", "12.0", "1e3", "2147483648", "2024-1-5", "2024-01-05 10:00:00", "yes", "t", "1",
        "NaN", "1,000", BAD, f"12{BAD}", f"2024-01-05 {BAD}", f"2024-01-05T{BAD}",
    ]
    for kind, nullable in itertools.product(kinds, (True, False)):
        cfg = TemplateConfig(columns=(ColumnConfig("v", kind, is_nullable=nullable),))
        df = spark.createDataFrame([("u", i, p, None) for i, p in enumerate(probes)], "upload_id string, row_number long, v string, _ragged string")
        by_rules = validate._any([r.broken for r in validate.cell_rules(df, cfg)])
        differing = df.filter(by_rules != validate.is_bad_row(df, cfg)).collect()
        assert differing == [], (kind, nullable)


@pytest.mark.parametrize(
    "kind, valid",
    [
        ("INTEGER", {"12", " 12 ", "1"}),
        ("BIGINT", {"12", " 12 ", "1", "2147483648"}),
        ("DOUBLE", {"12", " 12 ", "12.0", "1e3", "1", "2147483648", "NaN"}),
        ("DECIMAL", {"12", " 12 ", "12.0", "1e3", "1", "2147483648"}),
        ("BOOLEAN", {"yes", "t", "1"}),
        ("DATE", {"2024-1-5"}),  # a time of day would be lost
    ],
)
def test_types(spark, kind, valid):
    probes = ["12", " 12 ", "12.0", "1e3", "2147483648", "2024-1-5", "2024-01-05 10:00:00", "yes", "t", "1", "NaN", "1,000"]
    cfg = TemplateConfig(columns=(ColumnConfig("v", kind),))
    df = spark.createDataFrame([("u", i, p) for i, p in enumerate(probes)], "upload_id string, row_number long, v string")
    bad = {r.raw_value for r in validate.type_errors(df, cfg).collect()}
    accepted = set(probes) - bad
    assert accepted == valid


def test_bare_decimal_has_no_fraction():
    assert spark_type("DECIMAL").simpleString() == "decimal(10,0)"
    assert spark_type("decimal( 12 , 2 )").simpleString() == "decimal(12,2)"
    with pytest.raises(ValueError):
        spark_type("VARCHAR")


def verdict_of(spark, total, bad_rows, threshold, action, header=False):
    rows = spark.range(1, total + 1).select(F.lit("u").alias("upload_id"), F.lit("t").alias("template_id"))
    errors = [("u", n) for n in bad_rows] + ([("u", 0)] if header else [])
    errors = spark.createDataFrame(errors, "upload_id string, row_number long")
    templates = spark.createDataFrame([("t", threshold, action)], "template_id string, bad_row_threshold string, bad_row_action string")
    templates = templates.withColumn("bad_row_threshold", F.col("bad_row_threshold").cast("decimal(5,2)"))
    uploads = spark.createDataFrame([("u", "t")], "upload_id string, template_id string")
    return validate.verdict(rows, errors, templates, uploads).first()


@pytest.mark.parametrize(
    "total, bad_rows, threshold, action, outcome, dropped",
    [
        (100, [], "0", "fail", "completed", 0),
        (100, [1, 2, 3, 4, 5], "5.00", "drop", "partial", 5),  # equality passes
        (100, [1, 2, 3, 4, 5, 6], "5.00", "drop", "failed", 0),
        (100, [1, 1, 1, 1, 1, 1], "1.00", "drop", "partial", 1),  # rows, not cells
        (100, [1], "50", "fail", "failed", 0),
        (100, [1], "0", "drop", "failed", 0),
        (10, list(range(1, 11)), "100", "drop", "partial", 10),
        (0, [], "0", "fail", "completed", 0),  # no rows, 0 %
    ],
)
def test_verdict(spark, total, bad_rows, threshold, action, outcome, dropped):
    found = verdict_of(spark, total, bad_rows, threshold, action)
    assert (found.outcome, found.dropped_rows, found.total_rows) == (outcome, dropped, total)
    assert found.valid_rows + found.invalid_rows == found.total_rows


def test_bad_header_fails_the_upload(spark):
    found = verdict_of(spark, 10, [], "100", "drop", header=True)
    assert (found.outcome, found.invalid_rows, found.bad_pct) == ("failed", 0, 0.0)


def test_clean_rows_and_bad_rows_are_disjoint_and_complete(spark, rows, rows_of):
    tagged = rows.withColumn("template_id", F.lit("t"))
    errors = validate.validate(rows, CONFIG)
    templates = spark.sql("select 't' as template_id, cast(100 as decimal(5,2)) as bad_row_threshold, 'drop' as bad_row_action")
    clean = validate.clean_rows(rows, CONFIG, validate.verdict(tagged, errors, templates))
    good = set(rows_of(clean, "upload_id", "row_number"))
    bad = set(rows_of(errors.select("upload_id", "row_number").distinct()))
    assert not good & bad
    assert good | bad == {(r[0], r[1]) for r in ROWS}
    assert "skipped" not in clean.columns
    assert clean.schema["day"].dataType.simpleString() == "date"


def test_blank_cells_become_null(spark):
    cfg = TemplateConfig(columns=(ColumnConfig("a"), ColumnConfig("b", "INTEGER", column_order=1)))
    df = spark.createDataFrame([("u", 1, "  ", ""), ("u", 2, " x ", " 7 ")], "upload_id string, row_number long, a string, b string")
    assert [tuple(r) for r in validate.typed_rows(df, cfg, ()).collect()] == [(None, None), (" x ", 7)]


@pytest.mark.parametrize("limit", [10**9, 0])
@pytest.mark.parametrize("hot_rows", [2, 50, 10**6])
def test_repeated_keys_on_every_route(spark, rows_of, hot_rows, limit):
    """A key with a third of the rows, small groups and single rows; broadcast, spread
    and plain join must agree with a direct count."""
    df = spark.range(300).select(
        F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 150).alias("k"), F.lit("c").alias("c")
    )
    df = df.unionByName(spark.createDataFrame([(1000, 999, "c")], "row long, k long, c string"))
    data = [tuple(r) for r in df.collect()]
    counts = {}
    for _, k, _ in data:
        counts[k] = counts.get(k, 0) + 1
    found = skew.repeated_keys(df, ["c", "k"], "row", hot_rows, limit)
    assert rows_of(found) == sorted([r for r in data if counts[r[1]] > 1], key=repr)


def test_hot_rows_are_shuffled_by_slot(spark):
    """With shuffled joins, the partitioning of the rows must include the slot."""
    df = spark.range(10_000).select(
        F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 4000).alias("k")
    )
    lookup = spark.range(-1, 4000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        for joined in (skew.repeated_keys(df, ["k"], "row", 1000, 0), skew.lookup_join(df, lookup, ["k"], "row", "left", 1000)):
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert re.search(r"hashpartitioning\(k#\d+L, _slot#\d+L", plan), plan
            sizes = joined.groupBy(F.spark_partition_id().alias("p")).count()
            assert sizes.agg(F.max("count")).first()[0] < 3300  # the hot key alone has 3334
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("hot_rows", [2, 10**6])
@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_lookup_join_equals_plain_join(spark, rows_of, hot_rows, how):
    left = spark.range(200).select(
        F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 != 0, (F.col("id") % 11).cast("string")).alias("k")
    )
    right = spark.createDataFrame([("hot", 1), ("4", 2), ("unused", 3)], "k string, v int")
    plain = left.join(right, ["k"], how)
    found = skew.lookup_join(left, right, ["k"], "row", how, hot_rows)
    assert rows_of(found.select(*plain.columns)) == rows_of(plain)
    for limit in (10**9, 0):
        found = skew.measured_lookup(left, right, ["k"], "row", how, hot_rows, limit)
        assert rows_of(found.select(*plain.columns)) == rows_of(plain)


def test_header_check(spark):
    columns = spark.createDataFrame([("t", "a", 0), ("t", "b", 1), ("t", "c", 2)], "template_id string, column_name string, column_order int")
    headers = {
        "exact": ["a", "b", "c"],
        "reordered": ["b", "a", "c"],
        "missing": ["a", "b"],
        "extra": ["a", "b", "c", "d"],
        "duplicate": ["a", "b", "b"],
        "empty": [],
    }
    frame = spark.createDataFrame([(k, "t", v) for k, v in headers.items()], "upload_id string, template_id string, header array<string>")
    checked = gates.check_headers(frame, columns)
    found = {r.upload_id: (r.missing, r.extra, r.misplaced, r.repeated, r.header_ok) for r in checked.collect()}
    assert found["exact"] == ([], [], [], [], True)
    assert found["reordered"] == ([], [], ["a", "b"], [], False)
    assert found["missing"] == (["c"], [], [], [], False)
    assert found["extra"] == ([], ["d"], [], [], False)
    assert found["duplicate"] == (["c"], [], [], ["b"], False)
    assert found["empty"] == (["a", "b", "c"], [], [], [], False)
    assert {r.upload_id for r in gates.header_errors(checked).collect()} == set(headers) - {"exact"}


def test_infer_types(spark):
    cols = {
        "ints": ["1", " 2 ", ""], "longs": ["1", "2147483648", None], "doubles": ["1", "1.5", "1e3"],
        "flags": ["true", "f", "no"], "days": ["2024-1-5", "2024-12-31", ""], "texts": ["x", "1", ""],
        "blank": ["", None, "  "], "stamps": ["2024-01-05 10:00:00", "2024-01-05", "2024-01-06T00:00:00"],
    }
    df = spark.createDataFrame(list(zip(*cols.values())), ", ".join(f"{c} string" for c in cols))
    found = {r.column_name: (r.data_type, r.non_blank) for r in gates.infer_types(df).collect()}
    assert found == {
        "ints": ("INTEGER", 2), "longs": ("BIGINT", 2), "doubles": ("DOUBLE", 3), "flags": ("BOOLEAN", 3),
        "days": ("DATE", 2), "texts": ("STRING", 2), "blank": ("STRING", 0),
        "stamps": ("TIMESTAMP", 3),
    }


def test_gates(spark):
    df = spark.createDataFrame([("a.csv", 100), ("b.CSV", 101), ("c.txt", 1), ("noext", 1), ("d.xlsx", 0)], "path string, length long")
    found = {r.path: r.gate for r in gates.upload_gates(df, 100).collect()}
    assert found == {"a.csv": "ok", "b.CSV": "too_large", "c.txt": "wrong_extension", "noext": "wrong_extension", "d.xlsx": "ok"}


def test_unknown_expectation_drops_the_row(spark, rows_of):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 50)], "id int, v int")
    rules = publish.expectations(TemplateConfig(columns=(ColumnConfig("v", "INTEGER", is_nullable=False),)), {"small": "v < 10"})
    assert rows_of(publish.expect_or_drop(df, rules)) == [(1, 5)]
    log = sorted(tuple(r) for r in publish.expectation_log(df, rules).collect())
    assert log == [("small", 3, 1, 2), ("v_not_null", 3, 2, 1)]
    kept, seen = publish.observe_expectations(df, rules, "seen")
    assert kept.count() == 1
    assert sorted(publish.observed_log(seen, rules)) == log


def test_progress(spark):
    events = [
        ("done", 1, "file_uploaded"), ("done", 2, "schema_validated"), ("done", 3, "completed"),
        ("broken", 1, "file_uploaded"), ("broken", 2, "failed"), ("broken", 3, "writing_to_catalog"),
        ("started", 1, "in_progress"),
    ]
    df = spark.createDataFrame([(u, i, i, s) for u, i, s in events], "upload_id string, event_id int, ts int, status string")
    found = {r.upload_id: (r.status, r.step_number, r.is_terminal) for r in history.upload_progress(df).collect()}
    assert found == {"done": ("completed", 4, True), "broken": ("failed", 1, True), "started": ("in_progress", 0, False)}
    latest = {r.upload_id: (r.status, r.n_events) for r in history.current_uploads(df).collect()}
    assert latest["broken"] == ("writing_to_catalog", 3)


@pytest.mark.parametrize("limit, offset", [(0, 0), (201, 0), (10, -1)])
def test_page_bounds(spark, limit, offset):
    df = spark.createDataFrame([(1, 1, "a")], "id int, uploaded_at int, status string")
    with pytest.raises(ValueError):
        history.list_uploads(df, limit=limit, offset=offset)


STRICT = {
    "BIGINT": ({"1", " 2 ", "-3", "+4"}, {"12.0", "1e3", "5L", "0x10", "1 2"}),
    "DOUBLE": ({"1", "1.", ".5", "-1.5e-3", "NaN", "Infinity", "inf"}, {"5d", "7F", "100D", "0x1p3", ".", "e5"}),
    "DECIMAL(10,2)": ({"1", "1.9", "1.90", "1.99000", ".5", "-0.01", "1e2"}, {"1.999", "1e-3", "123456789.1", "."}),
    "DATE": ({"2024-01-05", "2024-1-5", " 2024-01-05 "}, {"2024", "2024-01", "2024-01-05Tjunk", "2024-01-05 anything", "2024-01-05 10:00:00", "2024-13-01"}),
    "TIMESTAMP": (
        {"2024-01-05", "2024-01-05 10:00", "2024-01-05T10:00:00.123Z", "2024-01-05 10:00:00+02:00"},
        {"2024", "2024-01-05Tjunk", "2024-01-05 10:00:00 junk", "10:00:00"},
    ),
    "BOOLEAN": ({"true", "false"}, {"maybe", "2"}),
}


@pytest.mark.parametrize("kind", sorted(STRICT))
def test_cells_read_as_their_type_or_not_at_all(spark, kind):
    good, bad = STRICT[kind]
    df = spark.createDataFrame([(v,) for v in good | bad], "v string")
    got = df.select("v", castable("v", spark_type(kind)).alias("ok"), typed("v", spark_type(kind)).alias("t")).collect()
    assert {r.v for r in got if r.ok} == good
    assert {r.v for r in got if r.t is not None} == good


def test_decimals_are_inferred(spark):
    df = spark.createDataFrame([("1.5", "1", "1.5", "x"), ("-22.125", "2", "1e3", "1.5"), ("", " ", None, "")], "a string, b string, c string, d string")
    assert [r.data_type for r in gates.infer_types(df).orderBy("position").collect()] == ["DECIMAL(5,3)", "INTEGER", "DOUBLE", "STRING"]
