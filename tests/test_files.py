"""Scans, row numbers, sinks, end-to-end and incremental ingest on real files."""

import dataclasses
import os

import pytest
from pyspark.sql import functions as F

from sluicegate.functions.paths import parse_stored_path, stored_path
from sluicegate.model import ColumnConfig, TemplateConfig
from sluicegate.operators.gates import check_headers, header_errors
from sluicegate.operators.provision import provision
from sluicegate.operators.validate import cell_errors, ragged_errors
from sluicegate.plans.ingest import IngestContext, ingest
from sluicegate.sources import files, records, sinks, workspace
from sluicegate.streaming.ingest import BATCH, ingest_stream
from sluicegate.streaming.quality import quality_stream

ABC = TemplateConfig(columns=tuple(ColumnConfig(n, column_order=i) for i, n in enumerate("abc")), template_id="abc")


def put(folder, name, content, encoding="utf-8"):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(str(folder), name)
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(content)
    return path


def scanned(spark, paths, cfg, **options):
    return files.with_row_numbers(files.scan_csv(spark, str(paths), cfg, **options))


def cells(df, *names):
    return [tuple(r) for r in files.data_rows(df).orderBy("_file_name", "row_number").select("row_number", *names).collect()]


@pytest.mark.parametrize("delimiter", [",", "|", "\t", ";"])
def test_delimiters(spark, tmp_path, delimiter):
    lines = [["a", "b", "c"], ["1", "x", "p"], ["2", "y", "q"]]
    put(tmp_path, "f.csv", "\n".join(delimiter.join(line) for line in lines) + "\n")
    cfg = dataclasses.replace(ABC, delimiter=delimiter)
    found = scanned(spark, tmp_path, cfg)
    assert cells(found, "a", "b", "c") == [(1, "1", "x", "p"), (2, "2", "y", "q")]
    assert files.header_rows(found, cfg).first().header == ["a", "b", "c"]


def test_row_numbers_across_splits(spark, tmp_path):
    """Two files of 50,000 rows in many splits; the value is the row's index."""
    for name in ("one.csv", "two.csv"):
        put(tmp_path, name, "a,b,c\n" + "".join(f"{i},x,{name}\n" for i in range(1, 50_001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        scan = files.scan_csv(spark, str(tmp_path), ABC)
        assert scan.rdd.getNumPartitions() > 10
        numbered = files.with_row_numbers(scan)
        data = files.data_rows(numbered)
        assert data.count() == 100_000
        assert data.filter(F.col("row_number") != F.col("a").cast("bigint")).count() == 0
        assert files.header_rows(numbered, ABC).count() == 2
        counted = files.record_counts(files.number_records(files.scan_csv(spark, str(tmp_path), ABC)).splits)
        assert {(r.upload_id, r.total_rows) for r in counted.collect()} == {("one.csv", 50_000), ("two.csv", 50_000)}
        without = put(tmp_path / "bare", "bare.csv", "".join(f"{i},x,y\n" for i in range(1, 20_001)))
        bare = files.with_row_numbers(files.scan_csv(spark, without, ABC), header=False)
        assert bare.filter(F.col("row_number") != F.col("a").cast("bigint")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_ragged_records_keep_their_text(spark, tmp_path):
    put(tmp_path, "ragged.csv", 'a,b,c\n1,2\n\n1,2,3\n1,2,3,4\n"x,y",2,"say ""hi"""\n')
    found = scanned(spark, tmp_path, ABC)
    good = files.data_rows(found).filter("_ragged is null").orderBy("row_number")
    assert [tuple(r) for r in good.select("row_number", "a", "b", "c").collect()] == [
        (2, "1", "2", "3"),  # blank lines are no records
        (4, "x,y", "2", 'say "hi"'),
    ]
    errors = ragged_errors(files.data_rows(found), ABC)
    assert sorted((r.row_number, r.column_name, r.error_type, r.raw_value) for r in errors.collect()) == [
        (1, "_row", "SCHEMA_MISMATCH", "1,2"),
        (3, "_row", "SCHEMA_MISMATCH", "1,2,3,4"),
    ]


def test_encodings(spark, tmp_path):
    put(tmp_path, "latin1.csv", "a,b,c\ncafé,x,y\n", "latin-1")
    right = dataclasses.replace(ABC, encoding="ISO-8859-1")
    assert cells(scanned(spark, tmp_path, right), "a") == [(1, "café")]
    assert cell_errors(files.data_rows(scanned(spark, tmp_path, right)), right).count() == 0
    wrong = cell_errors(files.data_rows(scanned(spark, tmp_path, ABC)), ABC).collect()
    assert [(r.row_number, r.column_name, r.error_type) for r in wrong] == [(1, "a", "ENCODING_ERROR")]
    assert [os.path.basename(r.path) for r in records.undecodable_files(spark, str(tmp_path)).collect()] == ["latin1.csv"]


def test_wide_encoding(spark, tmp_path):
    put(tmp_path, "wide.csv", "a,b,c\n1,é,z\n2,ü,z\n", "utf-16")
    cfg = dataclasses.replace(ABC, encoding="UTF-16")
    assert cells(scanned(spark, tmp_path, cfg), "a", "b") == [(1, "1", "é"), (2, "2", "ü")]


def test_empty_cells(spark, tmp_path):
    put(tmp_path, "empties.csv", 'a,b,c\n,"","  "\n')
    cfg = dataclasses.replace(ABC, columns=tuple(dataclasses.replace(c, is_nullable=False) for c in ABC.columns))
    errors = cell_errors(files.data_rows(scanned(spark, tmp_path, cfg)), cfg)
    assert sorted((r.column_name, r.error_type) for r in errors.collect()) == [(n, "NOT_NULL") for n in "abc"]


def test_headers_of_files(spark, tmp_path):
    headers = {
        "exact": "a,b,c", "reordered": "b,a,c", "missing": "a,b", "extra": "a,b,c,d", "duplicate": "a,b,b",
        "quoted": '"a","b","c"', "marked": "\N{ZERO WIDTH NO-BREAK SPACE}a,b,c",
    }
    for name, text in headers.items():
        put(tmp_path, f"{name}.csv", text + "\n1,2,3\n")
    found = files.header_rows(scanned(spark, tmp_path, ABC), ABC).withColumn("template_id", F.lit("abc"))
    columns = spark.createDataFrame([("abc", n, i) for i, n in enumerate("abc")], "template_id string, column_name string, column_order int")
    checked = check_headers(found, columns)
    ok = {r.upload_id.removesuffix(".csv") for r in checked.filter("header_ok").collect()}
    assert ok == {"exact", "quoted", "marked"}
    assert {(r.upload_id, r.row_number, r.error_type) for r in header_errors(checked).collect()} == {
        (f"{n}.csv", 0, "SCHEMA_MISMATCH") for n in ("reordered", "missing", "extra", "duplicate")
    }


def test_only_csv_is_scanned(spark, tmp_path):
    with pytest.raises(ValueError, match="xlsx"):
        files.scan_csv(spark, str(tmp_path), dataclasses.replace(ABC, file_format="xlsx"))


def test_inventory(spark, tmp_path):
    put(tmp_path / "x" / "y", "f.csv", "abc")
    put(tmp_path, "g.txt", "")
    listed = files.list_files(spark, str(tmp_path))
    assert {(r.name, r.length) for r in listed.collect()} == {("f.csv", 3)}
    empty = files.empty_files(spark, str(tmp_path))
    assert {(r.name, r.length) for r in empty.collect()} == {("g.txt", 0)}
    assert empty.columns == listed.columns
    assert "content" not in listed.columns
    path = listed.filter("name = 'f.csv'").first().path
    wanted = spark.createDataFrame([(path,), ("file:/nowhere.csv",)], "path string")
    assert {(r.path, r.file_exists) for r in files.existing_files(spark, str(tmp_path), wanted).collect()} == {
        (path, True),
        ("file:/nowhere.csv", False),
    }


def test_stored_path_round_trip(spark):
    df = spark.sql("select 'finance' as d, 'region_mapping' as t, timestamp '2024-01-05 10:02:03' as at")
    built = df.select(stored_path(F.lit("landing"), "d", "t", "at", F.lit("csv")).alias("p"))
    assert built.first().p == "landing/finance/region_mapping/region_mapping_20240105_100203.csv"
    parsed = built.select(parse_stored_path("p").alias("x")).select("x.*").first()
    assert (parsed.container, parsed.domain, parsed.template, parsed.extension) == ("landing", "finance", "region_mapping", "csv")
    assert str(parsed.received_at) == "2024-01-05 10:02:03"
    odd = spark.sql("select 'x/y/t/u_20240105_100203.csv' as p").select(parse_stored_path("p").alias("x")).first().x
    assert odd.template is None and odd.received_at is None


def test_append_and_overwrite(spark, tmp_path):
    rows = spark.createDataFrame([("1", "x", "p"), ("2", "y", "q")], "a string, b string, c string")
    path = str(tmp_path / "target")
    for _ in range(2):
        sinks.write_target(rows, ABC, "append", path)
    assert spark.read.parquet(path).count() == 4
    for _ in range(2):
        sinks.write_target(rows, ABC, "overwrite", path)
    assert spark.read.parquet(path).count() == 2
    sinks.write_target(spark.read.parquet(path).filter("a = '1'"), ABC, "overwrite", path)  # its own input
    assert spark.read.parquet(path).count() == 1
    sinks.write_target(rows, ABC, "append", table="appended_rows")
    sinks.write_target(rows, ABC, "append", table="appended_rows")
    assert spark.table("appended_rows").count() == 4


@pytest.mark.parametrize("scattered", [False, True])
def test_validated_folder_per_upload(spark, tmp_path, scattered):
    path = str(tmp_path / "validated")
    rows = spark.range(100).selectExpr("cast(id % 3 as string) as upload_id", "id as row_number")
    for _ in range(2):
        sinks.write_validated(rows, path, scattered=scattered)
    assert spark.read.schema(rows.schema).parquet(path).count() == 100
    sinks.write_validated(rows.filter("upload_id = '1' and row_number < 10"), path, scattered=scattered)
    assert spark.read.schema(rows.schema).parquet(path).groupBy("upload_id").count().orderBy("upload_id").collect() == [
        ("0", 34), ("1", 3), ("2", 33),
    ]


def test_only_own_folders_are_removed(spark, tmp_path):
    kept = workspace.materialise(spark.range(3), "kept", workspace.new_folder(spark, "run"))
    folder = os.path.dirname(os.path.dirname(kept.inputFiles()[0]))
    workspace.remove_folder(spark, folder.removeprefix("file://"))
    assert not os.path.exists(folder.removeprefix("file://"))
    with pytest.raises(ValueError):
        workspace.remove_folder(spark, str(tmp_path))


def test_large_files_are_pruned_from_the_scan(spark, tmp_path):
    put(tmp_path, "small.csv", "a,b,c\n1,2,3\n")
    put(tmp_path, "large.csv", "a,b,c\n" + "1,2,3\n" * 100)
    scan = files.scan_csv(spark, str(tmp_path), ABC, max_bytes=100)
    assert scan.rdd.getNumPartitions() == 1
    assert {os.path.basename(r._file) for r in scan.collect()} == {"small.csv"}


def test_repeated_slice_is_harmless(spark, tmp_path):
    rows = spark.createDataFrame([("1", "x", "p")], "a string, b string, c string")
    path = str(tmp_path / "target")
    for batch in ("0", "1", "1"):
        sinks.write_target(rows.withColumn("batch", F.lit(batch)), ABC, "append", path, slice_column="batch")
    assert spark.read.parquet(path).count() == 2


class Session:
    """The parts of a session that `shared_dir` looks at."""

    def __init__(self, master, folder=None):
        self.conf = {workspace.SHARED_DIR: folder}
        self.sparkContext = self
        self.master = master
        self.applicationId = f"app of {master}"


def test_shared_folder_comes_from_the_session():
    assert workspace.shared_dir(Session("spark://host:7077", "hdfs://shared/dir/")) == "hdfs://shared/dir"
    assert workspace.shared_dir(Session("local[2]", "/shared")) == "/shared"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        workspace.shared_dir(Session("spark://host:7077"))
    private = workspace.shared_dir(Session("local[2]"))
    assert os.path.isdir(private) and workspace.shared_dir(Session("local[2]")) == private


def test_broadcast_depends_on_the_measured_size(spark):
    df = spark.range(1000).select(F.col("id"), F.lit("x" * 100).alias("t"))
    assert workspace.sized(df, 200_000) is not None
    assert workspace.sized(df, 100_000) is None


# --- end to end -----------------------------------------------------------

SALES = TemplateConfig(
    columns=(
        ColumnConfig("code", "STRING", is_nullable=False, is_unique=True, column_order=0),
        ColumnConfig("amount", "INTEGER", is_nullable=False, column_order=1),
        ColumnConfig("internal", "STRING", is_included=False, column_order=2),
    ),
    template_id="sales",
    bad_row_threshold="50.00",
    bad_row_action="drop",
)
FILES = {
    "sales_20240101_000000.csv": "code,amount,internal\na,1,i\nb,2,i\n",
    "sales_20240102_000000.csv": "code,amount,internal\na,1,i\nb,x,i\nc,3,i\n",  # one bad row of three
    "sales_20240103_000000.csv": "code,amount,internal\na,1,i\na,2,i\nb,,i\n",  # all bad
    "sales_20240104_000000.csv": "amount,code,internal\n1,a,i\n",  # bad header
    "sales_20240105_000000.csv": "",  # nothing at all
    "sales_20240106_000000.csv": "code,amount,internal\n",  # header only
    "sales_20240107_000000.csv": "code,amount,internal\n" + "z" * 500 + ",1,i\n",  # too large
    "notes.txt": "not an upload",
}


def context(tmp_path, **changes):
    base = str(tmp_path / "out")
    return IngestContext(
        uploaded_by="ann@x.test",
        uploaded_at="2024-02-01 10:00:00",
        errors_path=f"{base}/errors",
        history_path=f"{base}/history",
        target_path=f"{base}/target",
        max_bytes=400,
        **changes,
    )


@pytest.fixture
def landing(tmp_path):
    for i, (name, content) in enumerate(FILES.items()):
        path = put(tmp_path / "landing", name, content)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(tmp_path / "landing")


def test_ingest(spark, tmp_path, landing):
    ctx = context(tmp_path, checks={"small": "amount < 3"}, validated_path=str(tmp_path / "out" / "validated"))
    result = ingest(spark, landing, SALES, ctx)
    verdicts = {r.upload_id[11:14].strip("_"): (r.outcome, r.total_rows, r.invalid_rows) for r in result.verdicts.collect()}
    outcomes = {r.upload_id: r.outcome for r in result.verdicts.collect()}
    assert outcomes == {
        "sales_20240101_000000.csv": "completed",
        "sales_20240102_000000.csv": "partial",
        "sales_20240103_000000.csv": "failed",
        "sales_20240104_000000.csv": "failed",
        "sales_20240105_000000.csv": "failed",
        "sales_20240106_000000.csv": "completed",
    }
    assert verdicts
    assert {os.path.basename(r.path): r.gate for r in result.rejected_files.collect()} == {
        "sales_20240107_000000.csv": "too_large",
        "notes.txt": "wrong_extension",
    }
    target = spark.read.parquet(ctx.target_path)
    assert target.columns == ["code", "amount", "uploaded_by", "uploaded_at", "source_file"]
    assert sorted((r.code, r.amount, r.source_file) for r in target.collect()) == [
        ("a", 1, "sales_20240101_000000.csv"),
        ("a", 1, "sales_20240102_000000.csv"),
        ("b", 2, "sales_20240101_000000.csv"),
    ]
    assert {str(r.uploaded_at) for r in target.collect()} == {"2024-02-01 10:00:00"}
    assert sorted(result.log) == [("amount_not_null", 4, 4, 0), ("code_not_null", 4, 4, 0), ("small", 4, 3, 1)]
    history = spark.read.parquet(ctx.history_path)
    steps = [r.status for r in history.filter("upload_id = 'sales_20240102_000000.csv'").orderBy("event_id").collect()]
    assert steps == ["file_uploaded", "schema_validated", "constraints_checked", "writing_to_catalog", "partial"]
    bad_header = history.filter("upload_id = 'sales_20240104_000000.csv'").orderBy("event_id").collect()
    assert [(r.status, r.valid_rows) for r in bad_header] == [("file_uploaded", None), ("failed", 0)]
    times = [r.ts for r in history.filter("upload_id = 'sales_20240102_000000.csv'").orderBy("event_id").collect()]
    assert times == sorted(times) and len(set(times)) > 2
    ends = history.filter("status in ('completed', 'partial')").select("upload_id", "written_rows").collect()
    assert {r.upload_id[6:14]: r.written_rows for r in ends} == {"20240101": 2, "20240102": 1, "20240106": 0}
    stored = spark.read.parquet(f"{ctx.history_path}_expectations")
    assert sorted((r.rule, r.processed, r.passed, r.dropped) for r in stored.collect()) == sorted(result.log)
    failed = [r.status for r in history.filter("upload_id = 'sales_20240103_000000.csv'").orderBy("event_id").collect()]
    assert failed == ["file_uploaded", "schema_validated", "constraints_checked", "failed"]
    assert history.select("upload_id").distinct().count() == 8
    header = result.errors.filter("row_number = 0").select("upload_id").distinct()
    assert {r.upload_id for r in header.collect()} == {"sales_20240104_000000.csv", "sales_20240105_000000.csv"}


def test_overwrite_keeps_the_newest_passing_file(spark, tmp_path, landing):
    ctx = context(tmp_path)
    cfg = dataclasses.replace(SALES, write_mode="overwrite")
    os.remove(os.path.join(landing, "sales_20240106_000000.csv"))
    for _ in range(2):
        ingest(spark, landing, cfg, ctx)
    target = spark.read.parquet(ctx.target_path)
    assert sorted((r.code, r.source_file) for r in target.collect()) == [
        ("a", "sales_20240102_000000.csv"),
        ("c", "sales_20240102_000000.csv"),
    ]


def test_nothing_passes_nothing_is_written(spark, tmp_path):
    put(tmp_path / "landing", "sales_20240104_000000.csv", FILES["sales_20240104_000000.csv"])
    ctx = context(tmp_path)
    result = ingest(spark, str(tmp_path / "landing"), SALES, ctx)
    assert not result.wrote and not os.path.exists(ctx.target_path)


def test_a_failing_run_leaves_its_start(spark, tmp_path, landing):
    ctx = context(tmp_path, checks={"broken": "no_such_column > 1"})
    with pytest.raises(Exception, match="no_such_column"):
        ingest(spark, landing, SALES, ctx)
    events = spark.read.parquet(ctx.history_path).select("status", "stage").distinct().collect()
    assert [tuple(r) for r in events] == [("file_uploaded", "start")]


def test_stream_takes_each_file_once_and_equals_the_batch(spark, tmp_path, rows_of):
    landing, ctx, checkpoint = tmp_path / "landing", context(tmp_path), str(tmp_path / "checkpoint")

    def run():
        ingest_stream(spark, str(landing), SALES, ctx, checkpoint, files_per_batch=1).awaitTermination()
        return spark.read.parquet(ctx.target_path)

    names = list(FILES)[:2]
    put(landing, names[0], FILES[names[0]])
    assert run().count() == 2
    put(landing, names[1], FILES[names[1]])
    assert run().count() == 4
    assert run().count() == 4  # nothing new
    slices = {r[BATCH] for r in run().select(BATCH).distinct().collect()}
    assert {x[-2:] for x in slices} == {"-0", "-1"} and len({x[:-2] for x in slices}) == 1
    batch = context(tmp_path / "batch")
    ingest(spark, str(landing), SALES, batch)
    columns = ("code", "amount", "uploaded_by", "source_file")
    assert rows_of(run(), *columns) == rows_of(spark.read.parquet(batch.target_path), *columns)


def test_multi_line_files_fail_where_quotes_stay_open(spark, tmp_path):
    cfg = dataclasses.replace(SALES, multi_line=True)
    put(tmp_path / "landing", "open.csv", 'code,amount,internal\na,1,"i\nb,2,i\n')
    put(tmp_path / "landing", "good.csv", 'code,amount,internal\n"a\nb",1,"i"\nc,2,\ufffd\n')
    result = ingest(spark, str(tmp_path / "landing"), cfg, context(tmp_path))
    assert {r.upload_id: r.outcome for r in result.verdicts.collect()} == {"open.csv": "failed", "good.csv": "completed"}
    errors = [(r.upload_id, r.error_type, r.error_message) for r in result.errors.collect()]
    assert errors == [("open.csv", "SCHEMA_MISMATCH", "A quoted cell is not closed in its file")]
    target = spark.read.parquet(context(tmp_path).target_path)
    assert sorted(r.code for r in target.collect()) == ["a\nb", "c"]


def test_empty_files_fail_once_on_a_stream(spark, tmp_path):
    landing, ctx = tmp_path / "landing", context(tmp_path)

    def run():
        ingest_stream(spark, str(landing), SALES, ctx, str(tmp_path / "checkpoint"), files_per_batch=1).awaitTermination()
        events = spark.read.parquet(ctx.history_path).filter("event_id > 0")
        return sorted((r.upload_id, r.status) for r in events.collect() if r.status in ("failed", "completed", "partial"))

    put(landing, "empty.csv", "")
    assert run() == [("empty.csv", "failed")]
    put(landing / "s", "é 1.csv", "")
    put(landing, "full.csv", "code,amount,internal\na,1,i\n")
    put(landing, "later.csv", "code,amount,internal\nb,1,i\n")
    expected = [("empty.csv", "failed"), ("full.csv", "completed"), ("later.csv", "completed"), ("s/é 1.csv", "failed")]
    assert run() == expected
    assert run() == expected


@pytest.mark.parametrize("name", ["a b.csv", "50%20.csv", "é+ü.csv", "r[1]{2}.csv"])
def test_unusual_file_names(spark, tmp_path, name):
    put(tmp_path / "landing", name, "code,amount,internal\na,1,i\n")
    ctx = context(tmp_path)
    assert ingest(spark, str(tmp_path / "landing"), SALES, ctx).verdicts.first().upload_id == name
    ctx = context(tmp_path / "stream")
    ingest_stream(spark, str(tmp_path / "landing"), SALES, ctx, str(tmp_path / "checkpoint")).awaitTermination()
    assert [r.source_file for r in spark.read.parquet(ctx.target_path).collect()] == [name]


def test_same_names_in_two_folders_are_two_uploads(spark, tmp_path):
    for folder in ("p", "q"):
        put(tmp_path / "landing" / folder, "a.csv", "code,amount,internal\nx,1,i\ny,2,i\n")
    ctx = context(tmp_path)
    result = ingest(spark, str(tmp_path / "landing"), SALES, ctx)
    assert sorted((r.upload_id, r.outcome, r.total_rows) for r in result.verdicts.collect()) == [
        ("p/a.csv", "completed", 2),
        ("q/a.csv", "completed", 2),
    ]
    assert sorted(r.source_file for r in spark.read.parquet(ctx.target_path).collect()) == ["p/a.csv"] * 2 + ["q/a.csv"] * 2
    stream = context(tmp_path / "stream")
    ingest_stream(spark, str(tmp_path / "landing"), SALES, stream, str(tmp_path / "checkpoint")).awaitTermination()
    assert {r.source_file for r in spark.read.parquet(stream.target_path).collect()} == {"p/a.csv", "q/a.csv"}
    with pytest.raises(ValueError, match="same upload id"):
        ingest(spark, str(tmp_path / "landing"), SALES, context(tmp_path / "again", upload_id=files.UPLOAD_ID))


BROKEN = 'code,amount,internal\n"x\ny",1,i\nz,2,"i\nj"\nw,3,"i, ""j"" k"\n'


def test_quoted_line_breaks(spark, tmp_path):
    put(tmp_path / "landing", "a.csv", BROKEN)
    put(tmp_path / "landing", "b.csv", 'code,amount,internal\n"p, ""q""",1,5" pipe\n')
    lenient = dataclasses.replace(SALES, bad_row_threshold="100.00")
    ctx = context(tmp_path)
    result = ingest(spark, str(tmp_path / "landing"), lenient, ctx)
    assert {r.upload_id: r.outcome for r in result.verdicts.collect()} == {"a.csv": "failed", "b.csv": "completed"}
    assert [r.code for r in spark.read.parquet(ctx.target_path).collect()] == ['p, "q"']
    found = result.errors.filter("upload_id = 'a.csv'").collect()
    assert [(r.row_number, r.column_name, r.error_type) for r in found] == [(0, "_row", "SCHEMA_MISMATCH")]

    ctx = context(tmp_path / "whole")
    whole = ingest(spark, str(tmp_path / "landing"), dataclasses.replace(SALES, multi_line=True), ctx)
    assert {r.upload_id: (r.outcome, r.total_rows) for r in whole.verdicts.collect()} == {
        "a.csv": ("completed", 3),
        "b.csv": ("completed", 1),
    }
    assert sorted(r.code for r in spark.read.parquet(ctx.target_path).collect()) == ['p, "q"', "w", "x\ny", "z"]


def test_streams_share_their_tables(spark, tmp_path):
    """Two templates, and one of them again with a fresh checkpoint, into one history."""
    ctx = context(tmp_path)
    for i, (folder, template) in enumerate([("one", "t1"), ("two", "t2"), ("one", "t1")]):
        put(tmp_path / folder, f"f{i}.csv", "code,amount,internal\na,1,i\nb,x,i\n")
        cfg = dataclasses.replace(SALES, template_id=template)
        ingest_stream(spark, str(tmp_path / folder), cfg, ctx, str(tmp_path / f"cp{i}")).awaitTermination()
    history = spark.read.parquet(ctx.history_path)
    assert history.select("run_id", "upload_id").distinct().count() == 4
    assert {r.template_id for r in history.select("template_id").distinct().collect()} == {"t1", "t2"}
    assert sinks.read_errors(spark, ctx.errors_path).count() == 4
    assert spark.read.parquet(ctx.target_path).count() == 4


def test_stream_into_a_provisioned_table(spark, tmp_path):
    """Batches add up, a repeated one replaces itself, and schema and comments stay."""
    table = "sales_target"
    cfg = dataclasses.replace(
        SALES,
        fully_qualified_name=table,
        columns=(dataclasses.replace(SALES.columns[0], is_pii=True), *SALES.columns[1:]),
    )
    spark.sql(f"drop table if exists {table}")
    provision(spark, [cfg], slice_column=BATCH)
    comments = {c.name: c.description for c in spark.catalog.listColumns(table)}
    assert comments["code"]
    ctx = dataclasses.replace(context(tmp_path), target_path=None, target_table=table)
    for i in range(3):
        put(tmp_path / "landing", f"f{i}.csv", f"code,amount,internal\na{i},1,i\nb{i},2,i\n")
        ingest_stream(spark, str(tmp_path / "landing"), cfg, ctx, str(tmp_path / "cp")).awaitTermination()
        assert spark.table(table).count() == 2 * (i + 1)
    once_more = spark.table(table).filter(F.col(BATCH).endswith("-1"))
    rows = workspace.materialise(once_more, "again")
    sinks.write_target(rows, cfg, "append", table=table, slice_column=BATCH)
    assert spark.table(table).count() == 6
    assert {c.name: c.description for c in spark.catalog.listColumns(table)} == comments

    plain = dataclasses.replace(cfg, fully_qualified_name="sales_plain", write_mode="overwrite")
    spark.sql("drop table if exists sales_plain")
    provision(spark, [plain])
    with pytest.raises(ValueError, match="columns|partitioned"):
        sinks.write_target(rows, plain, "append", table="sales_plain", slice_column=BATCH)
    sinks.write_target(rows.drop(BATCH), plain, table="sales_plain")
    sinks.write_target(spark.table("sales_plain").filter("amount = 2"), plain, table="sales_plain")
    assert [(r.code, r.amount) for r in spark.table("sales_plain").collect()] == [("b1", 2)]
    assert {c.name: c.description for c in spark.catalog.listColumns("sales_plain")}["code"] == comments["code"]


def test_quality_stream(spark, tmp_path):
    schema = "template_id int, uploaded_at timestamp, total_rows long, dropped_rows long"
    days = [(1, "2024-01-01 10:00:00", 10, 1), (1, "2024-01-01 11:00:00", 10, 2), (1, "2024-01-05 10:00:00", 5, 0)]
    source = str(tmp_path / "history")
    spark.createDataFrame(days, "template_id int, at string, total_rows long, dropped_rows long").selectExpr(
        "template_id", "cast(at as timestamp) as uploaded_at", "total_rows", "dropped_rows"
    ).coalesce(1).write.parquet(source)
    stream = quality_stream(spark.readStream.schema(schema).parquet(source))
    query = (
        stream.writeStream.format("memory").queryName("quality").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert [(str(r.day), r.uploads, r.total_rows, r.dropped_pct) for r in spark.table("quality").collect()] == [
        ("2024-01-01", 2, 20, 15.0)
    ]


def test_landed_texts_keep_below_the_upload_limit(spark, tmp_path, monkeypatch):
    from checks import files

    texts = [(i, f"line {i}\n" + 'word "x" ' * 400, "en") for i in range(300)]
    rows = spark.createDataFrame(texts, "doc_id bigint, text string, lang string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    context = files._context
    monkeypatch.setattr(files, "_context", lambda s: dataclasses.replace(context(s), max_bytes=250_000))
    got = files.multi_line_texts(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(i, t.strip(), lang) for i, t, lang in texts]


def test_a_start_looks_at_its_folder_once(spark, tmp_path, monkeypatch):
    """However many batches it has; files that lie there since go to the next start."""
    looks = []

    def looked_at(session, folder):
        looks.append(folder)
        return files.empty_files(session, folder)

    monkeypatch.setattr("sluicegate.streaming.ingest.empty_files", looked_at)
    landing, ctx = tmp_path / "landing", context(tmp_path)

    def run():
        ingest_stream(spark, str(landing), SALES, ctx, str(tmp_path / "checkpoint"), files_per_batch=1).awaitTermination()
        events = spark.read.parquet(ctx.history_path).filter("status in ('completed', 'failed')")
        return sorted((r.upload_id, r.status) for r in events.collect())

    for i in range(2):
        put(landing / f"d{i}", "a.csv", f"code,amount,internal\na{i},1,i\n")
    put(landing / "d0", "empty.csv", "")
    expected = [("d0/a.csv", "completed"), ("d0/empty.csv", "failed"), ("d1/a.csv", "completed")]
    assert run() == expected
    assert len(looks) == 1
    put(landing / "d1", "late.csv", "")
    assert run() == [*expected, ("d1/late.csv", "failed")]


def test_listings_of_many_folders_take_bounded_tasks(spark, tmp_path):
    """A task of a listing looks at many folders; more than 32 are listed by tasks at all."""
    for i in range(70):
        put(tmp_path / "landing" / f"d{i:02}", "a.csv", f"code,amount,internal\na{i},1,i\n" if i % 35 else "")
    before = spark.conf.get(workspace.LISTING_TASKS)
    try:
        spark.conf.unset(workspace.LISTING_TASKS)
        outcomes = ingest(spark, str(tmp_path / "landing"), SALES, context(tmp_path)).verdicts
        assert outcomes.groupBy("outcome").count().orderBy("outcome").collect() == [("completed", 68), ("failed", 2)]
        assert int(spark.conf.get(workspace.LISTING_TASKS)) == max(32, 4 * spark.sparkContext.defaultParallelism)
        spark.conf.set(workspace.LISTING_TASKS, "7")
        workspace.bound_listings(spark)
        assert spark.conf.get(workspace.LISTING_TASKS) == "7"
    finally:
        spark.conf.set(workspace.LISTING_TASKS, before)
