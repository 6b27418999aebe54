"""Structured Streaming: files that arrive, merged as sums; windows over event time.

Only sums are kept as state. Merged intensities are sums of weights, so a stream keeps them exactly; statistics that
need a group's mean are made from those sums and the second moments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def merge_stream(observations: DataFrame, keys: list[str]) -> DataFrame:
    """Inverse-variance means of an unbounded stream of (keys, value, sigma); run in update or complete mode."""
    w = 1 / (F.col("sigma") * F.col("sigma"))
    valid = observations.where(F.col("value").isNotNull() & (F.col("sigma") > 0))
    s = valid.groupBy(*keys).agg(F.sum(w).alias("w"), F.sum(w * F.col("value")).alias("wi"), F.count("*").alias("nobs"))
    return s.select(*keys, (F.col("wi") / F.col("w")).alias("value"), (1 / F.sqrt("w")).alias("sigma"), "nobs")


def tumbling(events: DataFrame, time: str, value: str, every: str, late: str, keys: list[str] = ()) -> DataFrame:
    """Count, sum and extremes a window of event time; later rows than the watermark are dropped by Spark."""
    e = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    a = e.groupBy(F.window("_t", every), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))
    return a.select(F.col("window.start").alias("window_start"), *keys, "n", "total", "low", "high")


def sessions(events: DataFrame, time: str, user: str, gap: str, late: str) -> DataFrame:
    e = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return e.groupBy(F.session_window("_t", gap), user).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("session_start"), user, "n")


def arriving_cif(spark: SparkSession, folder: str) -> DataFrame:
    """Items of CIF files as they arrive in a folder."""
    from ..session import ship_package
    from ..sources.cif import ITEMS, _items

    ship_package(spark)
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.cif*").load(folder)
    return files.select("path", "content").mapInArrow(_items(False), ITEMS)


def run_once(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there now and returns the result table; for tests and backfills."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
