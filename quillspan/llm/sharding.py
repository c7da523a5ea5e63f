"""Shards by jump consistent hashing: a key and the number of shards decide, with no table of ranges.

The jump loop runs over whole Arrow batches of keys. Slots are numbered without gathering a shard in one task: each
shard is cut into hashed buckets of bounded size, rows are numbered inside a bucket, and a bucket starts
where the sizes of the buckets before it end. The table of bucket sizes has one row per
ROWS_PER_BUCKET rows; the number of buckets follows the number of rows.

Defined results: a null text has no bytes (size 16, CRC 0); a null key is hashed as the key -1; repeated keys
go to one shard with slots of their own; an empty table gives an empty result; columns other than the key and
the text are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows that a slot-numbering task takes of one shard, on average.
ROWS_PER_BUCKET = 20_000
#: Bytes that a row costs besides its text.
ROW_OVERHEAD = 16


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key: keep the last jump that still lands below ``shards``."""
    state = keys.astype(np.uint64)
    at = np.full(len(state), -1, np.int64)
    ahead = np.zeros(len(state), np.int64)
    moving = np.arange(len(state))
    while len(moving := moving[ahead[moving] < shards]):
        at[moving] = ahead[moving]
        with np.errstate(over="ignore"):
            state[moving] = state[moving] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = (state[moving] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[moving] = ((at[moving] + 1) * (2.0**31 / draw)).astype(np.int64)
    return at


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a 64-bit key; keys are mixed first, so that runs of ids spread evenly."""

    @F.pandas_udf("int")
    def place(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return place(F.xxhash64(F.coalesce(key.cast("long"), F.lit(-1).cast("long"))))


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + ROW_OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        shard_of(F.col(id_col), shards).alias("shard"),
        shard_of(F.col(id_col), shards + 1).alias("grown_shard"),
    )
    if buckets is None:
        buckets = max(8, -(-docs.count() // (shards * ROWS_PER_BUCKET)))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "text_crc32", F.lit(7)), F.lit(buckets)))
    sizes = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "bucket").orderBy("id", "text_crc32", "size")
    return (
        rows.withColumn("nth", F.row_number().over(inside) - 1)
        .join(starts, ["shard", "bucket"])
        .select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("nth")).alias("slot"), "grown_shard")
    )


def write_shards(docs: DataFrame, shards: int, path: str, id_col: str = "doc_id") -> None:
    """Write ``docs`` as one folder per shard; the shard column is ``shard_``."""
    docs.withColumn("shard_", shard_of(F.col(id_col), shards)).write.partitionBy("shard_").parquet(path)
