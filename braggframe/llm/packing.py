"""Best-fit packing of token sequences, bulk-synchronous.

Texts are tokenised once; every piece keeps its length and a checksum of its ids, and is a row of a table, as every gap
is. Lengths are taken in classes, an octave each, from long to short. In a round the pieces of a class and the gaps that could
hold one are range-sorted together by size, and a sweep matches each piece with its successor, the smallest gap not yet
taken that holds it: sizes fall, gaps are stacked and pieces take the last one, so pieces of one size are told apart by
rank. Each range partition sweeps its own rows; what a piece leaves of a gap is stacked again where the sweep meets its
size. Pieces that found no gap there take the gaps that earlier partitions left, last ones first, by rank (which partition
serves which is settled from two counts a partition). A gap that holds several pieces of the class takes part with as many
slots. Then gaps are updated, and the round repeats while a gap can hold a piece; what is left opens sequences, as many as its
lengths need by themselves.

Neither pieces nor gaps are ever gathered: a task holds a range of about RANGE_ROWS of them, the driver two counts a range
and the numbers of pieces and gaps of each size.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bytebpe import byte_tokens
from .common import bounded_batches, column, stored, texts_of

#: Rows of a range of a sweep.
RANGE_ROWS = 200_000
_SWEPT = "id long, seq long, part int, rank long, length long"


def classes_of(capacity: int) -> list[tuple[int, int]]:
    """Ranges (above, to) of lengths up to half the capacity, from long to short: octaves, the last from capacity / 32 down."""
    ends = sorted({capacity // c for c in (2, 4, 8, 16, 32)} | {0}, reverse=True)
    return list(zip(ends[1:], ends[:-1], strict=True))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range by falling size, gaps before pieces: matched pieces (id, seq), then what is left, ranked by size.

    Left pieces have a rank and no seq, left gaps a rank and no id.
    """
    stack: list[tuple[int, int]] = []  # gaps that hold what comes now, the smallest last
    later: list[tuple[int, int]] = []  # what pieces left of gaps, smaller than what comes now: a heap by falling size
    lost, part = 0, None
    for batch in batches:
        out: list[tuple[int | None, int | None, int, int | None, int]] = []
        for kind, place, size, key, part in zip(*(column(batch, c).to_pylist() for c in ("kind", "place", "size", "key", "part")), strict=True):
            while later and -later[0][0] >= place:
                rest, seq = heapq.heappop(later)
                stack.append((-rest, seq))
            if kind == 0:
                stack.append((size, key))
            elif stack:
                room, seq = stack.pop()
                out.append((key, seq, part, None, size))
                if room > size:
                    heapq.heappush(later, (size - room, seq))
            else:
                out.append((key, None, part, lost, size))
                lost += 1
        yield _swept(out)
    for at in range(0, len(stack), 10_000):
        yield _swept([(None, seq, part, at + i, 0) for i, (_, seq) in enumerate(stack[at : at + 10_000])])


def _swept(rows: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["id", "seq", "part", "rank", "length"])


def served(left: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Which left gaps serve which left pieces: rows (part, first rank, count, gaps' part, the gaps' last rank).

    left: (part, pieces, gaps) by falling size. A part's pieces pop the last gaps of the parts before it.
    """
    stack: list[list[int]] = []
    out = []
    for part, pieces, gaps in left:
        rank = 0
        while rank < pieces and stack:
            holder, many = stack[-1]
            n = min(many, pieces - rank)
            out.append((part, rank, n, holder, many - 1))
            rank += n
            stack[-1][1] -= n
            if not stack[-1][1]:
                stack.pop()
        if gaps:
            stack.append([part, gaps])
    return out


def _round(pieces: DataFrame, gaps: DataFrame, high: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """One sweep of pieces (id, length) over gaps (seq, size): matched (id, seq, length), and pieces left (id, length)."""
    # Each slot has room for the class's longest piece; what is beyond that is the last slot's.
    opened = gaps.withColumn("_slots", F.greatest(F.lit(1), F.floor(F.col("size") / high)).cast("int")).select("seq", "size", "_slots", F.explode(F.sequence(F.lit(1), F.col("_slots"))).alias("_i"))
    size = F.when(F.col("_i") < F.col("_slots"), F.lit(high)).otherwise(F.col("size") - (F.col("_slots") - 1) * high).cast("long")
    slots = opened.select(F.lit(0).alias("kind"), F.least(size, F.lit(high)).alias("place"), size.alias("size"), F.col("seq").alias("key"))
    both = slots.unionByName(pieces.select(F.lit(1).alias("kind"), F.col("length").alias("place"), F.col("length").alias("size"), F.col("id").alias("key")))
    order = [F.desc("place"), F.asc("kind"), F.asc("key")]
    ranges = max(1, -(-rows // RANGE_ROWS))
    ranged = (both.repartitionByRange(ranges, *order) if ranges > 1 else both.coalesce(1)).sortWithinPartitions(*order)
    swept = stored(ranged.withColumn("part", F.spark_partition_id()).mapInArrow(_sweep, _SWEPT), "pack-swept")
    found, left = swept.where("id is not null and seq is not null").select("id", "seq", "length"), swept.where("id is not null and seq is null")
    if ranges > 1:
        count = lambda c: F.count(F.when(F.col("rank").isNotNull(), F.col(c)))
        counts = swept.groupBy("part").agg(count("id").alias("p"), count("seq").alias("g")).orderBy("part").collect()  # two counts a range
        table = pieces.sparkSession.createDataFrame(served([tuple(r) for r in counts]), "part int, _first long, _n long, _holder int, _last long")
        # At most two rows a range. A left piece is served by one segment at most.
        seeking = left.join(F.broadcast(table.withColumnRenamed("part", "_part")), (F.col("part") == F.col("_part")) & (F.col("rank") >= F.col("_first")) & (F.col("rank") < F.col("_first") + F.col("_n")), "left")
        left = seeking.where("_part is null")
        asked = seeking.where("_part is not null").select("id", "length", F.col("_holder").alias("part"), (F.col("_last") - (F.col("rank") - F.col("_first"))).alias("rank"))
        found = found.unionByName(asked.join(swept.where("id is null").select("seq", "part", "rank"), ["part", "rank"]).select("id", "seq", "length"))
    return found, left.select("id", "length")


def _sizes(df: DataFrame, size: str) -> dict[int, int]:
    """How many rows there are of each size: no more entries than the capacity."""
    return {r[0]: r[1] for r in df.groupBy(size).agg(F.count("*")).collect()}


def placed(spark: SparkSession, pieces: DataFrame, capacity: int) -> DataFrame:
    """The sequence of each piece: (id, seq) for stored pieces (id, length) with unique ids and lengths from 1 to capacity."""
    # Of two pieces above half the capacity none fits beside the other: each opens a sequence, the odd numbers.
    large = pieces.where(F.col("length") > capacity // 2).select("id", (2 * F.col("id") + 1).alias("seq"), "length")
    lengths = _sizes(pieces, "length")
    gaps = large.where(F.col("length") < capacity).select("seq", (F.lit(capacity) - F.col("length")).alias("size"))
    rooms = {capacity - n: many for n, many in lengths.items() if capacity // 2 < n < capacity}
    out, made = large.select("id", "seq"), 0
    for low, high in classes_of(capacity):
        want = {n: many for n, many in lengths.items() if low < n <= high}
        left = pieces.where((F.col("length") > low) & (F.col("length") <= high))
        while want:
            shortest = min(want)
            if not any(room >= shortest for room in rooms):
                # What fits nowhere opens sequences: 1 / k of one for a piece of which k fit.
                count = max(1, int(sum(many / (capacity // n) for n, many in want.items()) + 1e-6))
                gaps = gaps.unionByName(spark.range(made, made + count).select((2 * F.col("id")).alias("seq"), F.lit(capacity).cast("long").alias("size")))
                rooms[capacity] = rooms.get(capacity, 0) + count
                made += count
            # The smallest gaps that hold the longest piece, one a piece, are enough for all; larger ones would stay untouched.
            widest, spare = capacity, sum(want.values())
            for room in sorted(r for r in rooms if r >= max(want)):
                widest, spare = room, spare - rooms[room]
                if spare <= 0:
                    break
            rows = sum(want.values()) + sum(many * max(1, room // high) for room, many in rooms.items() if shortest <= room <= widest)
            found, left = _round(left, gaps.where((F.col("size") >= shortest) & (F.col("size") <= widest)), high, rows)
            used = found.groupBy("seq").agg(F.sum("length").alias("_used"))
            gaps = stored(gaps.join(used, "seq", "left").select("seq", (F.col("size") - F.coalesce("_used", F.lit(0))).alias("size")).where("size > 0"), "pack-gaps")
            out = out.unionByName(found.select("id", "seq"))
            rooms, want = _sizes(gaps, "size"), _sizes(left, "length")
    return out


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else the first takes what the full ones leave."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)] if n else []


def _tokenised(tokenizer: str, capacity: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = byte_tokens(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[tuple[int, int, int, int, int]] = []
            for i, ids in enumerate(tokens.encode(texts_of(batch))):
                ids = memoryview(ids + end)
                out += [(i, p, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for p, (s, n) in enumerate(pieces_of(len(ids) // 4, capacity))]
            at, *rest = (np.array(x, np.int64) for x in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 5
            keys = [column(batch, c).take(pa.array(at)) for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(rest[0].astype(np.int32)), *(pa.array(x) for x in rest[1:])], [c for c in batch.schema.names if c != "text"] + ["piece", "start", "length", "ids_crc32"])

    return run


def best_fit(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row a piece: keep columns, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Rows that repeat are packed each, and ties in length are broken by the rows'
    order in storage. A text beyond the capacity is cut, its first piece taking what the full ones leave; its ids are held in
    one task, four bytes each. An empty table gives an empty one. Other columns of docs are ignored, whatever their names.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    names = [f"_keep{i}" for i in range(len(keep))]
    texts = docs.select(*(F.col(f"`{k}`").alias(n) for k, n in zip(keep, names, strict=True)), F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name != "text")
    rows = texts.mapInArrow(_tokenised(tokenizer, capacity, end_id), f"{schema}, piece int, start long, length long, ids_crc32 long")
    pieces = stored(rows.withColumn("id", F.monotonically_increasing_id()), "pieces")
    where = placed(spark, pieces.select("id", "length"), capacity)
    over = W.partitionBy("seq").orderBy(F.desc("length"), "id").rowsBetween(W.unboundedPreceding, -1)
    joined = pieces.join(where, "id").withColumn("_at", F.coalesce(F.sum("length").over(over), F.lit(0)))
    return joined.select(*(F.col(n).alias(k) for k, n in zip(keep, names, strict=True)), "piece", "start", "length", "ids_crc32", F.col("seq").alias("sequence_id"), F.col("_at").cast("long").alias("offset"))
