"""Reading the given tables and storing intermediate ones in the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, StructField, StructType

from sluicegate.sources.workspace import remove_folder, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXT_ROWS = 512


def text_batches(spark: SparkSession) -> None:
    """Let Python see `TEXT_ROWS` rows at a time, unless the session asks for fewer: texts
    are large, and a batch of thousands of them is held twice on each side."""
    if int(spark.conf.get(ARROW_ROWS)) > TEXT_ROWS:
        spark.conf.set(ARROW_ROWS, str(TEXT_ROWS))


def widened(df: DataFrame, **columns: str) -> StructType:
    """The schema of a frame with further columns, given as name=type."""
    return StructType([*df.schema, *(StructField(n, DataType.fromDDL(t)) for n, t in columns.items())])


def fresh_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores until no column of the frame has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Staging:
    """A folder of intermediate tables in `spark.checkpoint.dir`.

    `keep` writes a frame and reads it back, which cuts its lineage: a lost executor costs
    the running stage, not the ones before. `drop` removes tables that nothing reads any
    more; `close` removes all, for callers that have written their result.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.folder = f"{shared_dir(spark)}/sluicegate/{label}-{uuid.uuid4().hex}"
        self._count = 0

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        self._count += 1
        path = f"{self.folder}/{label}-{self._count}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._staged_at = path
        return kept

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            remove_folder(self.spark, frame._staged_at)

    def close(self) -> None:
        remove_folder(self.spark, self.folder)
