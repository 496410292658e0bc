"""Incremental ingest: every new file is validated and written once."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sluicegate.model import TemplateConfig
from sluicegate.plans.ingest import IngestContext, ingest
from sluicegate.sources.files import empty_files, literal_path, path_below
from sluicegate.sources.workspace import any_path, bound_listings

BATCH = "ingest_batch"


def ingest_stream(
    spark: SparkSession,
    folder: str,
    cfg: TemplateConfig,
    ctx: IngestContext,
    checkpoint: str,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Watch a folder and run `ingest` over the files of each micro-batch; stops when no
    new file is left, and picks up there next time.

    The stream carries file names only, `files_per_batch` at a time; contents are read by
    the batch scan, splits and all. A batch owns one slice of an appended target, one run
    of the error table and one of the history, and replaces them when it is repeated. Its
    name is that of the query, which the checkpoint keeps, and the batch number, so that
    streams may share their tables. An upload is known by its path below `folder`.

    Spark's file stream counts empty files as new ones but shows no rows for them. So the first
    batch of a start also takes the empty files of the folder for which no other batch of the
    query left a receipt (the first event of an upload) in the history; they fail like any other.
    Like Spark's own listing, which all batches of a start share, that is one look at the folder.
    """
    below = path_below(spark, folder)
    ctx = dataclasses.replace(ctx, upload_id=ctx.upload_id or below, source_file=ctx.source_file or below)
    bound_listings(spark)
    names = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
        .select("path")
    )
    looked = False

    def run(batch: DataFrame, batch_id: int) -> None:
        nonlocal looked
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        run_id = f"{query}-{batch_id}"
        new = batch.select("path")
        if not looked:
            new = new.unionByName(_unreceived(batch.sparkSession, folder, ctx, query, batch_id))
        paths = [literal_path(path) for path in sorted({row.path for row in new.collect()})]
        looked = True
        if not paths:
            return
        slice_of_batch = (BATCH, run_id) if cfg.write_mode == "append" else None
        ingest(
            batch.sparkSession,
            paths,
            cfg,
            dataclasses.replace(ctx, run_id=run_id, slice=slice_of_batch),
        )

    return (
        names.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _unreceived(spark: SparkSession, folder: str, ctx: IngestContext, query: str, batch_id: int) -> DataFrame:
    """Empty files (path) below the folder that no other batch of this query has taken."""
    empty = empty_files(spark, folder).select("path", F.expr(ctx.upload_id).alias("upload_id"))
    receipts = f"{ctx.history_path.rstrip('/')}/run_id={query}-*/stage=start"
    if batch_id == 0 or not any_path(spark, receipts):
        return empty.select("path")
    events = spark.read.option("basePath", ctx.history_path).parquet(receipts)
    taken = events.filter(F.col("run_id") != f"{query}-{batch_id}").select("upload_id")
    return empty.join(taken, "upload_id", "left_anti").select("path")
