"""Shards by jump consistent hashing (Lamping and Veach, 2014)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARDS = 40
#: Bytes that a row takes besides its text.
ROW_BYTES = 16
#: Parts in which the rows of a shard are numbered.
SLICES = 1024
#: Multiplier of the generator that draws a key's jumps.
STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key, without a table of shards.

    A key's jumps are those shard counts at which it moves to the newest shard;
    it stands where its last jump below ``shards`` went. One pass of the loop
    moves all keys that still jump, of which e^-1 or so are left each time.
    """
    state = keys.astype(np.uint64)
    at, to = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    moving = np.arange(len(keys))
    while len(moving):
        at[moving] = to[moving]
        state[moving] = state[moving] * STEP + np.uint64(1)
        drawn = (state[moving] >> np.uint64(33)).astype(np.float64) + 1
        to[moving] = ((at[moving] + 1) * (float(2**31) / drawn)).astype(np.int64)
        moving = moving[to[moving] < shards]
    return at


def stable_key(doc_id: Column) -> Column:
    """The first 64 bits of the md5 of the id as text (null: no text), as a signed number."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 16), 16, -10).cast("long")


def shard_of(doc_id: Column, shards: int) -> Column:
    """The shard, 0 to ``shards`` - 1, by the id and the number of shards alone."""
    if shards < 1:
        raise ValueError("there must be one shard at least")

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64).view(np.uint64), shards), dtype="int32")

    return place(stable_key(doc_id))


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    The law is ``key``: id and shard count decide, and one more shard
    (``grown_shard``) takes rows only into itself. Slots number the rows of a
    shard from 0 without gaps, in the order of a hash of id, size and checksum.

    Only ids, sizes and checksums are shuffled. Equal ones are counted before
    they are, and a shard's rows are numbered in 1,024 slices of their order that
    start after the counted rows of those before, so neither a shard nor an id
    with a third of all rows is one task; rows equal in all three are
    interchangeable and come back from their count. A null text has size 16 and
    the checksum of no bytes; a null id is a key like any other; very long texts
    are only measured; an empty table gives no rows; other columns aren't read.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    counted = slim.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    place = F.xxhash64("doc_id", "size", "text_crc32")
    placed = counted.select("*", shard_of(F.col("doc_id"), shards).alias("shard"), shard_of(F.col("doc_id"), shards + 1).alias("grown_shard"), place.alias("h"))
    placed = placed.withColumn("slice", F.pmod("h", F.lit(SLICES)).cast("int"))
    # a row per shard and slice: SLICES x shards at most
    totals = placed.groupBy("shard", "slice").agg(F.sum("n").alias("rows"))
    earlier = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", "slice", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start"))
    own = Window.partitionBy("shard", "slice").orderBy("h", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("before", F.coalesce(F.sum("n").over(own), F.lit(0))).join(F.broadcast(starts), ["shard", "slice"])
    first = F.col("start") + F.col("before")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.explode(F.sequence(first, first + F.col("n") - 1)).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, files: int = 8) -> None:
    """Write all columns of ``docs`` as Parquet, a folder for each shard with at most ``files`` files.

    Rows of a shard are dealt to its files at random by the hash of id and text,
    so a shard is ``files`` tasks. A column named ``shard`` is refused.
    """
    if "shard" in docs.columns:
        raise ValueError("the input may not have a column named shard")
    named = docs.withColumn("shard", shard_of(F.col("doc_id"), shards))
    named.repartition(shards * files, "shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(files))).write.partitionBy("shard").parquet(path)
