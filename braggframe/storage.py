"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only below this many bytes; beyond it the join shuffles.
BROADCAST_BYTES = 24 << 20

_fallback: dict[str, str] = {}
_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one where that is unset and all runs on this machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _fallback:
        holder = tempfile.TemporaryDirectory(prefix="braggframe-")
        atexit.register(holder.cleanup)
        _fallback["dir"] = f"file://{holder.name}"
    return _fallback["dir"]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage of df with a Parquet table in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(df.sparkSession)}/braggframe/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """df as the side of a join, broadcast if the plan's own bound of its bytes is within BROADCAST_BYTES.

    The bound comes from file sizes and local rows and is never below what is read; a side that a filter makes small may so be
    left to a shuffle.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _clear() -> None:
    spark = SparkSession.getActiveSession() if _made else None
    for path in _made if spark else ():
        with contextlib.suppress(Exception):  # the JVM may have gone first; the tables are only left-overs
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


atexit.register(_clear)
