"""What the operators of this subpackage share: shared storage, size-checked joins, components, exact ranks."""

from __future__ import annotations

import atexit
import contextlib
import os
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from ..session import ship_package
from ..storage import shared_folder as storage

#: A side of a join is broadcast only below this many bytes; beyond it the join shuffles.
BROADCAST_BYTES = 24 << 20
#: Rows of a file of a stored table whose rows are bounded, and the least number of its files.
FILE_ROWS, LEAST_FILES = 100_000, 8
#: Rows and bytes of an Arrow batch sent to a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: The white space that ends a word: space and the controls 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

#: Of a query that has written its rows, the shuffle files can go at once; else they stay until the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_made: list[str] = []


@contextlib.contextmanager
def _shuffles_released(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def _clear() -> None:
    """Removes this application's tables from the shared folder when the driver ends."""
    spark = SparkSession.getActiveSession() if _made else None
    for path in _made if spark else ():
        with contextlib.suppress(Exception):  # the JVM may have gone first; the tables are only left-overs
            remove(spark, path)


atexit.register(_clear)


def new_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{storage(spark)}/braggframe/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Cuts the lineage of df with a Parquet table in the shared folder. The path is kept in .stored_at.

    rows: a bound of its rows, where one is known. A table of few rows is then written to few files, however many partitions
    the shuffle before it has; files of a handful of rows cost more to create and open than to read.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if rows is not None:
        df = df.coalesce(max(LEAST_FILES, -(-rows // FILE_ROWS)))
    return _stored_at(path, [df])


def stored_rounds(rounds: Iterable[DataFrame], name: str) -> DataFrame:
    """stored, of the union of one frame or more that are computed and written one after the other: one round's shuffle is on the disks at a time."""
    rounds = list(rounds)
    return _stored_at(new_path(rounds[0].sparkSession, name), rounds)


def _stored_at(path: str, rounds: list[DataFrame]) -> DataFrame:
    spark = rounds[0].sparkSession
    with _shuffles_released(spark):
        for df in rounds:
            df.write.mode("append").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    back = spark.read.schema(rounds[0].schema).parquet(path)
    back.stored_at = path
    return back


def kept(df: DataFrame) -> DataFrame:
    """A table that is read again, kept on the executors' disks beside their shuffle files.

    It creates no files in the shared folder. Its lineage is not cut: what a lost executor held is computed again, so this is for
    plans of a few steps that read the same on every evaluation, not for loops.
    """
    df = df.persist(StorageLevel.DISK_ONLY)
    df.count()
    return df


def drop_stored(*frames: DataFrame) -> None:
    """Removes stored tables and kept ones."""
    for df in frames:
        if hasattr(df, "stored_at"):
            remove(df.sparkSession, df.stored_at)
        else:
            df.unpersist()


def collected(spark: SparkSession) -> None:
    """A collection of the driver's garbage at the end of a phase of many small queries.

    The plans, broadcasts and metrics of these fill the heap, which the driver's JVM otherwise grows to its limit and does not give
    back; shuffles and broadcasts of dead plans go from the executors, too.
    """
    spark._jvm.System.gc()


def bounded_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small, so that long texts do not fill a worker's memory, and sends the package to the executors."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """A stored table as the side of a join: broadcast if its counted rows are within BROADCAST_BYTES, else left to a shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def dealt_rounds(rows: DataFrame, row_bytes: int, keys: list[str]) -> list[Column]:
    """Conditions that deal the keys of rows, a stored table, to as few rounds as leave each within BROADCAST_BYTES."""
    n = -(-rows.count() * row_bytes // BROADCAST_BYTES)
    return [F.pmod(F.xxhash64(*keys), F.lit(n)) == i for i in range(n)] if n > 1 else [F.lit(True)]


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [x or "" for x in column(batch, name).to_pylist()]


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array, nulls empty, and the offsets of its texts."""
    col = (col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col).fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and col.buffers()[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of the graph with the edges (a, b): alternating large and small stars until nothing moves.

    component is the smallest node that links reach. Neighbour lists are never gathered: a node's minimum is a
    partial aggregate that is joined back, so a hub splits like any skewed join.
    """
    current = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    count = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = count(current)
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        nearer = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # A round leaves no more edges than there were, and one a node.
        after = stored(nearer.unionByName(down.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), name, before[0])
        drop_stored(current)
        current = after
        if (mark := count(current)) == before:
            break
        before = mark
    collected(current.sparkSession)
    return current.select(F.col("a").alias("node"), F.col("b").alias("component"))


def ranked(df: DataFrame, keys: list[str], order: list[Column], out: str, rows_each: int = 50_000) -> DataFrame:
    """Adds out, the gapless rank from 0 of a row within its keys, without gathering a key in one task.

    Rows fall into parts of a key by the hash of their order columns, so these must tell rows apart: an id of the row is one
    of them, or equal rows would share a part. A part's rank is a window; the parts' offsets are a window over one row a
    part. df must read the same on every evaluation.
    """
    total = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("_n") / rows_each)).cast("int")
    from pyspark.sql import Window as W

    sized = total.select(*keys, parts.alias("_parts"))
    dealt = df.join(small_keys(sized, keys), keys).withColumn("_part", F.pmod(F.xxhash64(*order), F.col("_parts"))).drop("_parts")
    counts = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_c"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    within = dealt.withColumn("_rank", F.row_number().over(W.partitionBy(*keys, "_part").orderBy(*order)) - 1)
    return within.join(offsets, [*keys, "_part"]).withColumn(out, F.col("_rank") + F.col("_before")).drop("_part", "_rank", "_before")


def small_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key where the number of keys has a fixed bound (shards, lengths)."""
    return F.broadcast(df)


def long_schema(*fields: str) -> T.StructType:
    return T.StructType([T.StructField(f, T.LongType()) for f in fields])
