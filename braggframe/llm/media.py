"""Media columns: payloads as images in archives, and a Spark data source that reads members by byte range.

The archives are plain zip files with stored members. The source's plan lists the files of a directory and cuts each
into byte ranges; a task opens one archive, reads its central directory and streams the members whose local header
starts in its range, in Arrow batches of a bounded size. A member that fails is read again by itself, from its offset.
"""

from __future__ import annotations

import hashlib
import os
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import bounded_batches, column, new_path, opened, text_bytes

SIDE = 24
UNIT = SIDE * SIDE
PAD = 255
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 48 << 20, 16 << 20, 4 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes) -> bytes:
    """The bytes with 255, which UTF-8 never holds, up to a positive multiple of 576."""
    return data + bytes([PAD]) * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_image(payload: bytes) -> bytes:
    """A grey PNG of 8 bits and 24 columns."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, SIDE)
    lines = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1)
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", SIDE, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def from_image(media: bytes) -> bytes:
    """The samples of an image of to_image; raises ValueError if a checksum or the form differs."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, data, height = 8, b"", 0
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", body)
            if width != SIDE or form != [8, 0, 0, 0, 0]:
                raise ValueError("another form of PNG")
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, SIDE + 1)
    if lines[:, 0].any():
        raise ValueError("a filtered line")
    return lines[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Mean and deviation of the samples, and a histogram of 16 levels in thousandths."""
    x = np.frombuffer(payload, np.uint8)
    levels = np.bincount(x >> 4, minlength=16) * 1000 // len(x)
    return f"mean={x.mean():.4f};std={x.std():.4f};levels=" + ",".join(map(str, levels.tolist()))


def _writing(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = opened(folder)
        part, number, out = TaskContext.get().partitionId(), 0, None
        written: list[tuple[str, int]] = []

        def begin():
            held = f"{root}/_held-{uuid.uuid4().hex}"
            stream = fs.open_output_stream(held)
            return held, stream, zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED), [0, 0]

        def end() -> None:
            nonlocal out, number
            held, stream, archive, sums = out
            archive.close()
            stream.close()
            name = f"{root}/part-{part:06d}-{number:04d}.zip"  # an attempt that repeats a task replaces equal files
            fs.move(held, name)
            written.append((name, sums[0]))
            out, number = None, number + 1

        for batch in batches:
            data, offsets = text_bytes(column(batch, "text"))
            raw = data.tobytes()
            for i, doc in enumerate(column(batch, "doc_id").to_pylist()):
                out = out or begin()
                media = to_image(padded(raw[offsets[i] : offsets[i + 1]]))
                info = zipfile.ZipInfo(f"{'' if doc is None else doc}.png")
                out[2].writestr(info, media)
                out[3][0] += 1
                out[3][1] += len(media)
                if out[3][1] >= ARCHIVE_BYTES:
                    end()
        if out:
            end()
        yield pa.RecordBatch.from_arrays([pa.array([w[0] for w in written], pa.string()), pa.array([w[1] for w in written], pa.int64())], ["archive", "members"])

    return run


def write_archives(docs: DataFrame, folder: str) -> int:
    """Writes every text (null: empty) as an image, named by its doc_id, into archives under folder; returns the number of members.

    Archives appear under their final name only when complete.
    """
    bounded_batches(docs.sparkSession)
    fs, root = opened(folder)
    fs.create_dir(root, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    done = rows.mapInArrow(_writing(folder), "archive string, members long").agg(F.sum("members")).first()
    return done[0] or 0


class _Range(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


def read_member(f: pa.NativeFile, path: str, offset: int, size: int) -> bytes:
    """The stored bytes of the member whose local header is at offset of an open archive."""
    f.seek(offset)
    head = f.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no member at {offset} of {path}")
    name, extra = struct.unpack("<HH", head[26:30])
    f.seek(offset + 30 + name + extra)
    data = f.read(size)
    if len(data) != size:
        raise OSError(f"{len(data)} of {size} bytes at {offset} of {path}")
    return data


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.batch_bytes = int(options.get("batchBytes", BATCH_BYTES))
        self.retries = int(options.get("retries", 3))
        self.pause = float(options.get("pause", 0.1))

    def partitions(self):
        fs, root = opened(self.path)
        files = sorted((f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(root)) if f.is_file and f.path.endswith(".zip"))
        return [_Range(path, at, min(size, at + self.range_bytes)) for path, size in files for at in range(0, size, self.range_bytes)] or [_Range("", 0, 0)]

    def read(self, partition):
        fs, _ = opened(self.path)
        rows, size = [], 0
        if not partition.path:
            return
        with fs.open_input_file(partition.path) as f, zipfile.ZipFile(f) as z:
            members = [(m.header_offset, m.file_size, m.CRC, m.filename) for m in z.infolist() if partition.first <= m.header_offset < partition.last]
        f = None
        for offset, length, crc, name in members:
            for attempt in range(self.retries + 1):
                try:
                    f = f or fs.open_input_file(partition.path)
                    data = read_member(f, partition.path, offset, length)
                    if zlib.crc32(data) != crc:
                        raise OSError(f"wrong checksum at {offset} of {partition.path}")
                    break
                except (OSError, ValueError):
                    f = f and f.close()  # the next attempt opens the archive anew, after a pause
                    if attempt == self.retries:
                        raise
                    time.sleep(self.pause * 2**attempt)
            rows.append((os.path.basename(partition.path), name, offset, data))
            size += length
            if size >= self.batch_bytes:
                yield _batch(rows)
                rows, size = [], 0
        if f:
            f.close()
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple[str, str, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.binary()))], ["archive", "member", "at", "media"])


class MediaArchives(DataSource):
    """spark.read.format("media_archives").load(folder): archive, member, at, media. Options: rangeBytes, batchBytes, retries, pause (seconds, doubled at each)."""

    @classmethod
    def name(cls):
        return "media_archives"

    def schema(self):
        return "archive string, member string, at long, media binary"

    def reader(self, schema):
        return _Reader(self.options)


def read_archives(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    bounded_batches(spark)
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").options(**options).load(folder)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for member, media in zip(column(batch, "member").to_pylist(), column(batch, "media").to_pylist(), strict=True):
            payload = from_image(media)
            doc = member.removesuffix(".png")
            rows.append((int(doc) if doc else None, len(payload.rstrip(bytes([PAD]))), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(payload)))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def media_columns(docs: DataFrame) -> DataFrame:
    """Stores every text as an image in archives, reads the archives back and measures what the images hold.

    A null or empty text is 576 bytes of padding. Rows that repeat are members each; a null doc_id stays null. A very long text is
    one image, held whole by one task. Other columns are ignored, whatever their names. An empty table has no archive and
    gives no row.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "media")
    write_archives(docs, folder)
    return read_archives(spark, folder).mapInArrow(_measured, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
