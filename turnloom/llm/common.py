"""Shared plumbing: the shared folder, row keys and Arrow text buffers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.operators.ranking import in_slices
from turnloom.shared import cut, scratch  # noqa: F401  cut is part of this module for its callers

DOC_KEY, TIE_KEY = "__d", "__t"
NULL_ID = -(2**63)
#: Bits of a text's hash that part the rows of one id where they are numbered.
SLICE_BITS = 10


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_shuffles(spark: SparkSession) -> None:
    """Let the driver drop the shuffle files of plans that nothing refers to any more.

    Spark removes them when the driver's garbage collector meets them, which a
    driver with little to do puts off while executors' disks fill.
    """
    spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Parquet is several times smaller than a checkpoint, so larger intermediate
    tables go this way; executors that are lost afterwards cost nothing.
    """
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    free_shuffles(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of a batch for Python where whole texts are read; Spark's own 64 MB are held two or three times by both sides of each task.
BATCH_BYTES = str(8 << 20)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Actions within send texts to Python in batches of BATCH_BYTES, or of one text that is longer."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(df: DataFrame) -> None:
    """Delete a table of ``materialize`` that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def refuse_names(df: DataFrame, *names: str) -> None:
    """Columns of these names, or of the row keys, would be overwritten: they are an error."""
    taken = {DOC_KEY, TIE_KEY, *names} & set(df.columns)
    if taken:
        raise ValueError(f"the input may not have columns named {', '.join(sorted(taken))}")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_row_key(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Add ``__d`` (the id, null as the smallest long) and ``__t``, unique together.

    ``__t`` is 0 wherever ids are unique, which one slim pass over the ids
    finds out. Rows that share an id (or have none) are numbered by their text,
    so equal inputs give equal keys; wholly identical rows are interchangeable.
    Only the rows of repeated ids are numbered, in 1,024 slices of a hash of their
    texts that start after the counted rows before them, so an id that a third of
    all rows have (or none) isn't one task.
    """
    keyed = df.withColumn(DOC_KEY, F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)))
    clashes = keyed.groupBy(DOC_KEY).count().filter("count > 1").select(DOC_KEY)
    if clashes.limit(1).isEmpty():
        return keyed.withColumn(TIE_KEY, F.lit(0))
    alone = keyed.join(clashes, DOC_KEY, "left_anti").withColumn(TIE_KEY, F.lit(0)).select(*keyed.columns, TIE_KEY)
    shared = keyed.join(clashes, DOC_KEY, "left_semi")
    place = F.xxhash64("text") if "text" in df.columns else F.xxhash64(*df.columns)
    order = [F.col("__h"), *(F.col(c) for c in df.columns if c == "text")]
    dealt = shared.withColumn("__h", place).withColumn("__slice", F.shiftright("__h", 64 - SLICE_BITS))
    numbered = in_slices(dealt, [DOC_KEY], order, keyed.columns, TIE_KEY, None)
    return alone.unionByName(numbered.withColumn(TIE_KEY, (F.col(TIE_KEY) - 1).cast("int")))


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and int64 offsets of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def spans_of_rows(offsets: np.ndarray, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most_bytes`` each, or of one row that is longer."""
    n = len(offsets) - 1
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most_bytes, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def held_out(doc_id: F.Column) -> F.Column:
    """One document in five never trains a model: crc32 of its id as text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, text, y of at most ``most`` labelled documents that aren't held out.

    The ids with the least hashes are taken, so that every run takes the same.
    Of several labels of one id the largest counts, of several texts the least.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")
