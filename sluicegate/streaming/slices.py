"""Tables that a stream's batches add to: one slice for each batch, replaced if it is repeated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sluicegate.sources.workspace import any_path


class SlicedTable:
    """Parquet slices below a folder, by batch number."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def put(self, batch_id: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")

    def drop(self, batch_id: int) -> None:
        """Remove the slice of a batch that won't be looked at again."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/batch={batch_id}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def all(self) -> DataFrame:
        """Every slice, with its `batch`; no rows before the first."""
        if not any_path(self.spark, f"{self.folder}/batch=*"):
            return self.spark.createDataFrame([], f"{self.schema}, batch bigint")
        return self.spark.read.schema(f"{self.schema}, batch bigint").parquet(self.folder)

    def before(self, batch_id: int) -> DataFrame:
        return self.all().filter(f"batch < {batch_id}")

    def one(self, batch_id: int) -> DataFrame:
        """One slice alone, without looking at the others."""
        path = f"{self.folder}/batch={batch_id}"
        if not any_path(self.spark, path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(path)


def run_batches(rows: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Call `work` with every micro-batch of what is there now; the checkpoint knows what was done."""
    return rows.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
