"""Tables that streams add to, lineages, samples of errors and mergeable profiles."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sluicegate.operators.approvals import replay_status, with_rounds
from sluicegate.operators.history import error_samples, quality_by_day
from sluicegate.operators.lineage import lineages
from sluicegate.operators.profile import DISTINCT_ERROR, RANK_ERROR, merge_profiles, profile_columns, profile_estimates
from sluicegate.operators.registry import deprecate_older, latest_versions
from sluicegate.streaming.lifecycle import LifecycleTables
from sluicegate.streaming.quality import QualityTables

START = datetime(2024, 1, 1)
UPLOADS = "template_id bigint, uploaded_at timestamp_ntz, total_rows bigint, dropped_rows bigint"
EVENTS = "template_id bigint, ts timestamp_ntz, event_id bigint, to_status string"


def source(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def test_late_rows_are_corrections_and_a_restart_counts_nothing_twice(spark, tmp_path, rows_of):
    draw = random.Random(1)
    uploads = [(draw.randint(1, 3), START + timedelta(hours=draw.randint(0, 240)), draw.randint(0, 9), 0) for _ in range(60)]
    uploads += [(None, START, 1, 1), (1, START + timedelta(days=9), 0, 0)]
    tables = QualityTables(spark, str(tmp_path / "q"))
    for part in (uploads[:20], uploads[20:40], uploads[40:]):
        put(spark, tmp_path / "in", part, UPLOADS)
        tables.follow(source(spark, tmp_path / "in", UPLOADS), str(tmp_path / "cp")).awaitTermination()
    everything = quality_by_day(spark.createDataFrame(uploads, UPLOADS))
    assert rows_of(tables.corrected()) == rows_of(everything)
    late = tables.corrections().agg(F.sum("uploads")).first()[0]
    assert late > 0
    assert tables.finished().agg(F.sum("uploads")).first()[0] == len(uploads) - late
    tables.add(spark.createDataFrame(uploads[40:], UPLOADS), 2)  # the last batch once more
    assert rows_of(tables.corrected()) == rows_of(everything)
    assert tables.corrections().agg(F.sum("uploads")).first()[0] == late


def test_a_day_the_watermark_has_passed_is_not_touched(spark, tmp_path):
    tables = QualityTables(spark, str(tmp_path / "q"), "1 day")
    tables.add(spark.createDataFrame([(1, START + timedelta(days=2), 5, 1)], UPLOADS), 0)
    tables.add(spark.createDataFrame([(1, START, 7, 0), (1, START + timedelta(days=1), 3, 0)], UPLOADS), 1)
    assert [(r.day.day, r.uploads) for r in tables.finished().orderBy("day").collect()] == [(2, 1), (3, 1)]
    assert [(r.day.day, r.total_rows) for r in tables.corrections().collect()] == [(1, 7)]


def test_no_batches_yet(spark, tmp_path):
    assert QualityTables(spark, str(tmp_path / "q")).corrected().collect() == []
    tables = LifecycleTables(spark, str(tmp_path / "l"))
    assert tables.status().collect() == [] and tables.reminders().collect() == []


def test_streamed_status_equals_the_replay(spark, tmp_path, rows_of):
    draw = random.Random(2)
    kinds = ["Pending Approval", "Pending DDL", "Approved", "Draft"]
    events = [(draw.randint(1, 12), START + timedelta(hours=draw.randint(0, 400)), i, draw.choice(kinds)) for i in range(90)]
    events += [(99, START + timedelta(hours=5), 1000, "Pending Approval")]
    tables = LifecycleTables(spark, str(tmp_path / "l"), days=3)
    for k in range(3):
        put(spark, tmp_path / "in", events[k::3], EVENTS)
        tables.follow(source(spark, tmp_path / "in", EVENTS), str(tmp_path / "cp")).awaitTermination()
    assert rows_of(tables.status()) == rows_of(replay_status(spark.createDataFrame(events, EVENTS)))
    now = max(e[1] for e in events)
    last = {}
    for template, ts, event_id, status in sorted(events, key=lambda e: (e[1], e[2])):
        last[template] = (ts, status)
    due = {(t, ts) for t, (ts, status) in last.items() if status == "Pending Approval" and ts < now - timedelta(days=3)}
    sent = [(r.template_id, r.pending_since) for r in tables.reminders().collect()]
    assert len(sent) == len(set(sent)) and due <= set(sent) and (99, START + timedelta(hours=5)) in due
    before = rows_of(tables.reminders())
    tables.add(spark.createDataFrame(events[2::3], EVENTS), 2)
    assert rows_of(tables.reminders()) == before
    assert rows_of(tables.status()) == rows_of(replay_status(spark.createDataFrame(events, EVENTS)))


def test_lineages_of_long_chains_circles_and_missing_parents(spark):
    rows = [(i, None if i % 40 == 0 else i - 1) for i in range(120)] + [(200, 201), (201, 202), (202, 200), (203, 200), (204, 203)]
    rows += [(300, 999), (301, 300), (400, 400), (500, None)] + [(1000 + i, 500) for i in range(50)] + [(None, 1)]
    random.Random(3).shuffle(rows)
    found = lineages(spark.createDataFrame(rows, "id bigint, parent_template_id bigint")).collect()
    got = {r.id: (r.root_id, r.steps, r.in_cycle) for r in found}
    assert len(found) == len(got) == len(rows) - 1
    assert all(got[i] == (i - i % 40, i % 40, False) for i in range(120))
    assert all(got[i] == (None, None, True) for i in (200, 201, 202, 203, 204, 400))
    assert got[300] == (999, 1, False) and got[301] == (999, 2, False)
    assert all(got[1000 + i] == (500, 1, False) for i in range(50))
    assert lineages(spark.createDataFrame([], "id bigint, parent_template_id bigint")).collect() == []


def test_versions_of_versions_are_one_lineage(spark):
    rows = [(1, None, 1, "Approved"), (2, 1, 2, "Approved"), (3, 2, 3, "Approved"), (4, 3, 4, "Draft"), (9, None, 1, "Approved")]
    templates = spark.createDataFrame(rows, "id int, parent_template_id int, version int, status string")
    chains = lineages(templates)
    assert sorted((r.root_id, r.id) for r in latest_versions(templates, chains).collect()) == [(1, 4), (9, 9)]
    after = {r.id: r.status for r in deprecate_older(templates, chains).collect()}
    assert after == {1: "Deprecated", 2: "Deprecated", 3: "Approved", 4: "Draft", 9: "Approved"}


def test_samples_do_not_depend_on_how_rows_are_dealt(spark, rows_of):
    rows = [(u, n, "c", kind, "m", None if n % 9 == 0 else f"v{n % 50}") for u in (1, 2) for n in range(500) for kind in ("A", "B")]
    rows += [(3, 1, "c", "A", "m", "only")]
    errors = spark.createDataFrame(rows, "upload_id int, row_number bigint, column_name string, error_type string, error_message string, raw_value string")
    samples = error_samples(errors, 4)
    assert {(r.upload_id, r.error_type): len(r.samples) for r in samples.collect()} == {
        (1, "A"): 4, (1, "B"): 4, (2, "A"): 4, (2, "B"): 4, (3, "A"): 1,
    }
    assert rows_of(error_samples(errors.repartition(7, "row_number"), 4)) == rows_of(samples)


@pytest.mark.parametrize("uploads", [1, 5])
def test_merged_profiles_keep_their_bounds(spark, uploads):
    n = 20_000
    rows = spark.range(n).select(
        (F.col("id") % uploads).alias("upload_id"),
        F.when(F.col("id") % 4 == 0, " ").otherwise((F.col("id") * 7919 % n).cast("string")).alias("number"),
        F.when(F.col("id") % 3 == 0, "often").otherwise(F.concat(F.lit("word "), F.col("id") % 2000)).alias("word"),
    )
    merged = merge_profiles(profile_columns(rows, ["number", "word"]))
    got = {r.column_name: r for r in profile_estimates(merged).collect()}
    number, word = got["number"], got["word"]
    assert (number.filled, number.blank, number.numbers) == (15_000, 5_000, 15_000)
    assert abs(number.distinct_values - 15_000) <= 4 * DISTINCT_ERROR * 15_000
    assert abs(word.distinct_values - 2_001) <= 4 * DISTINCT_ERROR * 2_001
    assert abs(number.median - n / 2) <= 4 * RANK_ERROR * n
    assert word.numbers == 0 and word.median is None
    assert word.top_values[0].item == "often" and abs(word.top_values[0]["count"] - n / 3) < n / 100


def test_approvals_without_a_time_are_of_the_first_round(spark):
    rows = [(1, "a", None), (1, "b", START), (1, "c", START + timedelta(days=1)), (None, "d", START)]
    approvals = spark.createDataFrame(rows, "template_id int, reviewer_email string, created_at timestamp_ntz")
    assert {r.reviewer_email: r["round"] for r in with_rounds(approvals).collect()} == {"a": 1, "b": 1, "c": 2, "d": 1}
