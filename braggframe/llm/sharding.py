"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

A group is the set of rows of equal text. It stays in one shard unless it holds more than half of a shard's mean bytes: such a
group is cut into parts of at most a HEAVY-th of a shard, and its rows are dealt to the parts in turn. Every group and part is an
item that is placed, largest first, in the shard where the dot product of its bytes, tokens and rows with the shard's residual
capacity is highest, among the shards whose bytes still fit.

Items of more than a HEAVY-th of a shard's bytes, of which there can only be a fixed number, are placed first. What capacity
they leave is then divided: light groups fall by a hash into portions of about PORTION groups, each portion has its share
of every shard's residual capacity, and a task places the groups of a portion one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, bounded_batches, column, ranked, small, stored

#: Groups that a task places together, and the share of a shard above which a group is placed before all others.
PORTION, HEAVY = 20_000, 16
#: Share of its own capacity by which a shard's bytes may be passed, so that tokens and rows still decide over the last items.
SLACK = 0.004
OVERHEAD = 8


def place(items: np.ndarray, left: np.ndarray, first: int = 0) -> np.ndarray:
    """The shard of each item (a row of loads): largest first, to the highest dot product with the residual capacity.

    left, the shards' residual capacity, is used up. Loads are measured by the capacity left in all, each kind by its own. Of
    equal shards the one next from first is taken. A shard that has no room for the item's first load, or SLACK of its capacity
    more, is only taken if none has; then the one with most room is.
    """
    scale = np.where(left.sum(axis=0) > 0, left.sum(axis=0), 1.0)
    share = items / scale
    rest = np.roll(left / scale, -first, axis=0)
    slack = SLACK * rest[:, 0]
    out = np.zeros(len(items), int)
    for i in np.lexsort((np.arange(len(items)), *(-items[:, k] for k in reversed(range(items.shape[1]))))):
        fits = rest[:, 0] + slack >= share[i, 0]
        out[i] = np.argmax(np.where(fits, rest @ share[i], -np.inf)) if fits.any() else np.argmax(rest[:, 0])
        rest[out[i]] -= share[i]
    left[:] = np.roll(rest, first, axis=0) * scale
    return (out + first) % len(left)


def _placing(left: list[list[float]], total: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Groups come sorted by portion. A portion's share of what is left is that of its loads in all light groups' loads."""

    def placed(portion: int, rows: list[tuple]) -> pa.RecordBatch:
        items = np.array([r[2:] for r in rows], float)
        part = np.array(left) * (items.sum(axis=0) / np.maximum(np.array(total, float), 1.0))
        to = place(items, part, portion % len(left))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(to, pa.int32())], ["_a", "_b", "_light"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for portion, *row in zip(*(column(batch, c).to_pylist() for c in ("portion", "_a", "_b", "bytes", "tokens", "n")), strict=True):
                if portion != now:
                    if held:
                        yield placed(now, held)
                    held, now = [], portion
                held.append(row)
        if held:
            yield placed(now, held)

    return run


def vector_shards(docs: DataFrame, shards: int, keep: list[str], text: str = "text") -> DataFrame:
    """keep columns of docs, then size (UTF-8 bytes and 8), text_crc32, shard and slot (gapless from 0 in a shard).

    The law is bytes: the shards' sizes are near equal. Tokens are the words of a text. A null text is its own group, of 0
    bytes and crc 0, apart from the empty text's. Repeated rows are rows each; ties in a slot's order are broken by the order
    in storage. A very long text is one row and one item, however large. Other columns of docs are ignored, whatever their
    names. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    names = [f"_keep{i}" for i in range(len(keep))]
    t = F.col(f"`{text}`").cast("string")
    rows = docs.select(*(F.col(f"`{k}`").alias(n) for k, n in zip(keep, names, strict=True)), t.alias("_text"))
    raw = F.coalesce(F.col("_text"), F.lit(""))
    rows = rows.select(*names, (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw.cast("binary")).cast("long").alias("text_crc32"), F.regexp_count(raw, F.lit(WORD)).cast("long").alias("_tokens"), F.xxhash64(F.col("_text").isNull(), raw).alias("_a"), F.xxhash64(F.lit(1), raw, F.col("_text").isNull()).alias("_b"))
    rows = stored(rows.withColumn("_id", F.monotonically_increasing_id()), "shard-rows")
    total = rows.count()
    groups = stored(rows.groupBy("_a", "_b").agg(F.sum("size").alias("bytes"), F.sum("_tokens").alias("tokens"), F.count("*").alias("n")), "shard-groups", total)
    loads, many = ["bytes", "tokens", "n"], groups.count()
    sums = [x or 0 for x in groups.agg(*(F.sum(c) for c in loads)).first()]
    mean = sums[0] / shards
    heavy = F.col("bytes") > mean / HEAVY
    parts = F.when(F.col("bytes") > mean / 2, F.least(F.col("n"), F.ceil(F.col("bytes") * HEAVY / F.lit(mean or 1.0)))).otherwise(F.lit(1)).cast("int")
    # Fewer than shards * HEAVY groups can be heavy.
    big = groups.where(heavy).withColumn("parts", parts).select("_a", "_b", *loads, "parts").orderBy("_a", "_b").collect()
    left = np.tile(np.array(sums, float) / shards, (shards, 1))
    items = [[r[c] / r.parts for c in loads] for r in big for _ in range(r.parts)]
    to = place(np.array(items, float).reshape(-1, 3), left).tolist()
    heavy_rows, at = [], 0
    for r in big:
        heavy_rows.append((r["_a"], r["_b"], to[at : at + r.parts]))
        at += r.parts
    heavy_map = spark.createDataFrame(heavy_rows, T.StructType([T.StructField("_a", T.LongType()), T.StructField("_b", T.LongType()), T.StructField("_to", T.ArrayType(T.IntegerType()))]))
    rest = [s - sum(r[c] for r in big) for c, s in zip(loads, sums, strict=True)]
    portions = max(1, -(-many // PORTION))
    light = groups.where(~heavy).withColumn("portion", F.pmod("_a", F.lit(portions)).cast("int"))
    light = light.repartition(min(portions, 2000), "portion").sortWithinPartitions("portion", "_a", "_b").mapInArrow(_placing(np.maximum(left, 0).tolist(), rest), "_a long, _b long, _light int")
    light = small(stored(light, "shard-light"), 24)
    columns = [*names, "_id", "size", "text_crc32"]
    # Rows of heavy groups are dealt to the parts in turn, by exact rank; they are kept out of the join by group.
    marked = rows.join(F.broadcast(heavy_map), ["_a", "_b"], "left")
    one = marked.where("_to is null").join(light, ["_a", "_b"]).select(*columns, F.col("_light").alias("shard"))
    dealt = ranked(marked.where("_to is not null"), ["_a", "_b"], [F.col("_id")], "_r").select(*columns, F.get("_to", (F.col("_r") % F.size("_to")).cast("int")).alias("shard"))
    dealt = stored(one.unionByName(dealt), "shard-dealt")
    out = ranked(dealt, ["shard"], [F.col(n) for n in names] + [F.col("_id")], "slot")
    return out.select(*(F.col(n).alias(k) for k, n in zip(keep, names, strict=True)), "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))
