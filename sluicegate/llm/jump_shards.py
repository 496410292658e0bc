"""Sharding by jump consistent hashing.

A row's shard follows from its key and the number of shards alone; there is no table of
ring positions. Going from n to n + 1 shards moves 1 / (n + 1) of the keys, all of them
into the new shard.

Defined results: a NULL key hashes as the key 0 and stays NULL; a NULL or empty text has no bytes, so its size
is the overhead alone and its checksum 0. Equal keys share a shard, however many rows
have them, and equal rows get slots of their own; very long texts are measured whole, and rows
of one key are numbered by checksum, then size. An empty frame gives an empty frame.
Other columns are left out, so that no name can clash; join the result back on the key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluicegate.llm.tables import Staging, widened

LAW = "key"
ROW_OVERHEAD = 8

# Fixed values of the published generator: multiplier, and the draw's scale.
_MULTIPLIER = 2862933555777941757
_SCALE = float(1 << 31)

# Rows that one task numbers at most, apart from rows that are equal in every column.
ROWS_PER_PIECE = 2_000_000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, 0 to `shards` - 1, of each 64-bit key."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.int64).view(np.uint64).copy()
    shard = np.full(len(state), -1, dtype=np.int64)
    ahead = np.zeros(len(state), dtype=np.int64)
    open_ = np.arange(len(state))
    while len(open_):
        shard[open_] = ahead[open_]
        state[open_] = state[open_] * np.uint64(_MULTIPLIER) + np.uint64(1)
        draw = (state[open_] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[open_] = ((shard[open_] + 1) * (_SCALE / draw)).astype(np.int64)
        open_ = open_[ahead[open_] < shards]
    return shard


def with_shards(df: DataFrame, key: str, shards: int) -> DataFrame:
    """`df` with `shard` and `grown_shard`, the row's place among `shards` and one more."""
    if {"shard", "grown_shard"} & set(df.columns):
        raise ValueError("the frame already has a column shard or grown_shard")
    at = df.columns.index(key)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(at).fill_null(0).to_numpy(zero_copy_only=False)
            columns = [*batch.columns, *(pa.array(jump(keys, n), pa.int32()) for n in (shards, shards + 1))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "shard", "grown_shard"])

    return df.mapInArrow(place, widened(df, shard="int", grown_shard="int"))


def shard_rows(
    docs: DataFrame,
    shards: int,
    key: str = "doc_id",
    text: str = "text",
    rows_per_piece: int = ROWS_PER_PIECE,
) -> DataFrame:
    """One row per document: key, size, text_crc32, law, shard, slot, grown_shard.

    `slot` numbers a shard's rows from 0 without gaps in the order of key, checksum and
    size. No shard passes through one task: the narrow rows are range-partitioned, each
    piece is numbered alone and starts where the pieces before it end. Starts jobs.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    narrow = docs.select(
        F.col(f"`{key}`").cast("bigint").alias("key"),
        (F.octet_length(body) + F.lit(ROW_OVERHEAD)).cast("bigint").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    staging = Staging(spark, "shards")
    placed = staging.keep(with_shards(narrow, "key", shards), "placed")
    pieces = max(1, -(-placed.count() // rows_per_piece), int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["key", "text_crc32", "size"]
    # The tie-break lets even one key's rows lie in several pieces.
    dealt = staging.keep(
        placed.withColumn("tie", F.monotonically_increasing_id())
        .repartitionByRange(pieces, *order, "tie")
        .withColumn("piece", F.spark_partition_id()),
        "dealt",
    )
    staging.drop(placed)
    # At most pieces x shards rows: a thousandth of the input and less.
    starts = (
        dealt.groupBy("shard", "piece")
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn(
            "start",
            F.sum("rows").over(Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)),
        )
        .select("shard", "piece", F.coalesce("start", F.lit(0)).alias("start"))
    )
    inside = F.row_number().over(Window.partitionBy("shard", "piece").orderBy(*order, "tie"))
    return (
        dealt.withColumn("inside", inside)
        .join(starts, ["shard", "piece"])
        .select(
            F.col("key").alias(key),
            "size",
            "text_crc32",
            F.lit(LAW).alias("law"),
            "shard",
            (F.col("start") + F.col("inside") - 1).cast("bigint").alias("slot"),
            "grown_shard",
        )
    )


def write_shards(placed: DataFrame, docs: DataFrame, path: str, key: str = "doc_id") -> None:
    """Write whole documents as Parquet under `path`/shard=N. A shard may have many files; keys
    must be unique, and a column of the documents named shard or slot is an error."""
    if {"shard", "slot"} & {c.lower() for c in docs.columns}:
        raise ValueError("the frame already has a column shard or slot")
    docs.join(placed.select(key, "shard", "slot"), key).write.partitionBy("shard").parquet(path)
