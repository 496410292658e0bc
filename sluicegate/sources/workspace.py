"""Shared folder for intermediate tables, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARED_DIR = "spark.checkpoint.dir"

# Upper bound of a hinted broadcast, in bytes of cell text (see `broadcast_if_small`).
BROADCAST_BYTES = 128 * 1024 * 1024
_ROW_OVERHEAD = 32

LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
_TASKS_PER_CORE = 4
_LEAST_TASKS = 32

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a private one only for local sessions that name none."""
    named = spark.conf.get(SHARED_DIR, None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {SHARED_DIR} to a folder that all executors can reach")
        _local_dirs[app] = tempfile.mkdtemp(prefix="sluicegate-")
    return _local_dirs[app]


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/sluicegate/{label}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder that `new_folder` made, once nothing reads it any more."""
    if not folder.startswith(f"{shared_dir(spark)}/sluicegate/"):
        raise ValueError(f"not a folder of this library: {folder}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def any_path(spark: SparkSession, pattern: str) -> bool:
    """Whether some file or folder fits a pattern of paths."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return bool(found)


def bound_listings(spark: SparkSession) -> None:
    """Let the session's listings of many files or folders take a few tasks per core, each of
    which looks at many paths. Spark's default is a task per path, which costs more than the look.
    It stays set, as a stream lists in this session while it runs; a lower value is kept."""
    few = max(_LEAST_TASKS, _TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    if int(spark.conf.get(LISTING_TASKS)) > few:
        spark.conf.set(LISTING_TASKS, str(few))


def materialise(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Write a frame once and read it back: lineage is cut, a lost executor loses
    nothing, and Catalyst plans the rest with the table's real size. `folder` (one of
    `new_folder`) holds several tables that are removed together."""
    spark = df.sparkSession
    path = f"{folder}/{label}" if folder else new_folder(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame | None:
    """`df` with a broadcast hint if its measured size allows it, else None. Meant for
    frames that were materialised before: the measurement is one aggregate over them."""
    width = F.lit(_ROW_OVERHEAD)
    for name in df.columns:
        width = width + F.coalesce(F.octet_length(F.col(f"`{name}`").cast("string")), F.lit(0)) + F.lit(8)
    size = df.agg(F.sum(width.cast("bigint"))).first()[0] or 0
    return F.broadcast(df) if size <= limit else None


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """`sized`, or the frame without a hint, so that the join shuffles."""
    side = sized(df, limit)
    return df if side is None else side
