"""Registered queries of streamed history and lifecycle, profiles, samples and lineages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixtures import stored, table, view, with_views
from checks.validation import NAMES, _errors, report
from sluicegate.operators import history, lineage, profile, registry
from sluicegate.sources.workspace import materialise, new_folder
from sluicegate.streaming.lifecycle import WAITING, LifecycleTables
from sluicegate.streaming.quality import QualityTables

FILES = 4


def _as_stream(rows: DataFrame, key: str) -> DataFrame:
    """The rows from `FILES` files, a file per batch, in an order that has nothing to do with time."""
    spark = rows.sparkSession
    folder = new_folder(spark, "stream")
    rows.repartition(FILES, key).write.parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _followed_quality(spark: SparkSession, sf: str) -> QualityTables:
    tables = QualityTables(spark, new_folder(spark, "quality"))
    uploads = view(spark, sf, "upload_history").select("id", "template_id", "uploaded_at", "total_rows", "dropped_rows")
    tables.follow(_as_stream(uploads, "id"), new_folder(spark, "checkpoint")).awaitTermination()
    return tables


def streamed_quality(spark, sf):
    """Days and corrections together, from uploads that come in no order."""
    return _followed_quality(spark, sf).corrected()


def streamed_corrections(spark, sf):
    """Late rows are counted in the corrections, and in them alone."""
    tables = _followed_quality(spark, sf)
    on_time = tables.finished().select("template_id", "day", F.col("uploads").alias("on_time"))
    late = tables.corrections().select("template_id", "day", F.col("uploads").alias("late"))
    both = on_time.join(late, ["template_id", "day"], "full").fillna(0, ["on_time", "late"])
    sums = both.groupBy("day").agg(F.sum(F.col("on_time") + F.col("late")).alias("uploads"), F.sum("late").alias("late"))
    some_late = F.lit(not sums.filter("late > 0").isEmpty())
    return sums.select("day", "uploads", some_late.alias("some_came_late"))


def _followed_lifecycle(spark: SparkSession, sf: str) -> LifecycleTables:
    tables = LifecycleTables(spark, new_folder(spark, "lifecycle"))
    tables.follow(_as_stream(view(spark, sf, "lifecycle_events"), "event_id"), new_folder(spark, "checkpoint")).awaitTermination()
    return tables


def streamed_status(spark, sf):
    return _followed_lifecycle(spark, sf).status()


def streamed_reminders(spark, sf):
    """Reminders of waits that are still going on."""
    tables = _followed_lifecycle(spark, sf)
    waiting = tables.status().filter(F.col("status") == WAITING).select("template_id", F.col("changed_at").alias("pending_since"))
    return tables.reminders().join(waiting, ["template_id", "pending_since"], "left_semi").select("template_id", "pending_since")


def sampled_errors(spark, sf):
    samples = history.error_samples(_errors(spark, sf), 3)
    return samples.select("upload_id", "error_type", "column_name", F.posexplode("samples").alias("place", "s")).select(
        "upload_id", "error_type", "column_name", "place", "s.row_number", "s.raw_value"
    )


def merged_profiles(spark, sf):
    """Profiles of all uploads merged: exact counts, and whether the estimates keep their bounds."""
    rows = stored(spark, sf, "raw_orders")
    stored_profiles = materialise(profile.profile_columns(rows, NAMES), "profiles")
    estimates = profile.profile_estimates(profile.merge_profiles(stored_profiles))
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("column_name"), F.trim(n).alias("value")) for n in NAMES]))
    long = rows.select(cells.alias("c")).select("c.*").filter("value <> ''")
    exact = long.groupBy("column_name").agg(F.countDistinct("value").alias("distinct"))
    number = F.col("value").try_cast("double")
    below = (
        long.join(F.broadcast(estimates.select("column_name", "median")), "column_name")
        .groupBy("column_name")
        .agg(F.sum((number < F.col("median")).cast("int")).alias("below"), F.sum((number <= F.col("median")).cast("int")).alias("upto"))
    )
    share = 4 * profile.RANK_ERROR * F.col("numbers")
    return estimates.join(exact, "column_name", "left").join(below, "column_name", "left").select(
        "column_name",
        "filled",
        "blank",
        (F.abs(F.col("distinct_values") - F.col("distinct")) <= 4 * profile.DISTINCT_ERROR * F.col("distinct") + 1).alias("distinct_holds"),
        F.coalesce((F.col("below") <= F.col("numbers") / 2 + share) & (F.col("upto") >= F.col("numbers") / 2 - share), F.lit(True)).alias("median_holds"),
    )


def _chained(spark, sf):
    """Templates whose versions point to the version before, in chains of twenty; in one block of
    seven the first points forward again, which closes a circle."""
    key = F.col("p_partkey")
    parent = F.when(key % 20 != 0, key - 1).when(F.floor(key / 20) % 7 == 3, key + 4)
    approved = F.when(key % 3 == 0, "Approved").otherwise("Draft")
    return table(spark, sf, "part").select(
        key.alias("id"), parent.alias("parent_template_id"), (key % 20 + 1).cast("int").alias("version"), approved.alias("status")
    )


def template_lineages(spark, sf):
    return lineage.lineages(_chained(spark, sf))


def latest_of_chains(spark, sf):
    templates = _chained(spark, sf)
    return registry.latest_versions(templates, lineage.lineages(templates)).select("root_id", "id", "version")


_CHAINS_SQL = """with recursive chained as (select p_partkey as id, case when p_partkey % 20 <> 0 then p_partkey - 1
    when floor(p_partkey / 20) % 7 = 3 then p_partkey + 4 end as up, p_partkey % 20 + 1 as version from part),
walk as (select id, id as at, 0 as n from chained
  union all select w.id, c.up, w.n + 1 from walk w join chained c on c.id = w.at where c.up is not null and w.n < 30),
ends as (select id, max(n) as n from walk group by id),
found as (select w.id, case when e.n < 30 then w.at end as root_id, case when e.n < 30 then e.n end::bigint as steps, e.n = 30 as in_cycle
  from ends e join walk w on w.id = e.id and w.n = e.n)
"""

QUERIES = {
    "streamed_quality": (
        streamed_quality,
        with_views(
            "upload_history",
            "select template_id, cast(uploaded_at as date) as day, count(*) as uploads, "
            "cast(sum(total_rows) as bigint) as total_rows, cast(sum(dropped_rows) as bigint) as dropped_rows, "
            "cast(sum(dropped_rows) * 100 as double) / sum(total_rows) as dropped_pct from upload_history group by 1, 2",
        ),
    ),
    "streamed_corrections": (
        streamed_corrections,
        with_views(
            "upload_history",
            "select cast(uploaded_at as date) as day, count(*) as uploads, true as some_came_late from upload_history group by 1",
        ),
    ),
    "streamed_status": (
        streamed_status,
        with_views(
            "lifecycle_events",
            "select template_id, to_status as status, ts as changed_at, n_events from (select *, row_number() over "
            "(partition by template_id order by ts desc, event_id desc) as rn, count(*) over (partition by template_id) "
            "as n_events from lifecycle_events) as x where rn = 1",
        ),
    ),
    "streamed_reminders": (
        streamed_reminders,
        with_views(
            "lifecycle_events",
            "select template_id, ts as pending_since from (select *, row_number() over (partition by template_id "
            "order by ts desc, event_id desc) as rn, max(ts) over () as now from lifecycle_events) as x "
            "where rn = 1 and to_status = 'Pending Approval' and ts < now - interval '3' day",
        ),
    ),
    "error_samples": (
        sampled_errors,
        report(
            "select upload_id, error_type, column_name, (rn - 1)::int as place, row_number, raw_value from (select *, "
            "row_number() over (partition by upload_id, error_type, column_name "
            "order by md5(row_number || ':' || coalesce(raw_value, '')), row_number) as rn from errors) as x where rn <= 3"
        ),
    ),
    "merged_profiles": (
        merged_profiles,
        with_views(
            "raw_orders",
            " union all ".join(
                f"select '{n}' as column_name, (count(*) filter (trim({n}) <> ''))::bigint as filled, "
                f"(count(*) filter (trim({n}) = '' or {n} is null))::bigint as blank, true as distinct_holds, true as median_holds "
                "from raw_orders"
                for n in NAMES
            ),
        ),
    ),
    "template_lineages": (template_lineages, _CHAINS_SQL + "select * from found"),
    "latest_of_chains": (
        latest_of_chains,
        _CHAINS_SQL
        + """select root_id, id, version::int as version from (select coalesce(f.root_id, f.id) as root_id, f.id, version,
  row_number() over (partition by coalesce(f.root_id, f.id) order by version desc, f.id desc) as rn
  from found f join chained c on c.id = f.id) as x where rn = 1""",
    ),
}
