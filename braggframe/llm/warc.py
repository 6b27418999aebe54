"""WARC archives: written and read as streams, captures assembled by concurrent-to identifiers.

A capture is three records: request, response (or revisit) and metadata; request and metadata name the response's record
in WARC-Concurrent-To. Payloads are equal if their SHA-1, their length and another hash are. To tell first ones from later
ones, the table of repeated digests is joined to the pages: broadcast within its size check, and only beyond it are pages
shuffled, by digest, where Spark splits a digest that many pages share.

A task writes its records one after the other and begins another file when one has FILE_BYTES, so an archive is larger than
that by one capture at most. Archives are read as streams, record by record: neither writing nor reading holds more than a
capture and an Arrow batch. With compression every record is a gzip member of its own.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, column, new_path, opened, small, stored

END = "\r\n"
#: Bytes after which an archive is closed, and of records in a batch that is read.
FILE_BYTES, READ_BYTES = 32 << 20, 4 << 20
FIXED_DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreservation.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, payload_bytes long, payload_digest string, digest_ok boolean, fields map<string,string>, payload string"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of a SHA-1, from 40 bits at a time."""
    hexed = F.sha1(data)
    quarter = lambda i: F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0")
    return F.translate(F.upper(F.concat(*map(quarter, range(4)))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(kind: str, record_id: Column, block: Column, *more: tuple[str, Column]) -> Column:
    head = [("WARC-Type", F.lit(kind)), ("WARC-Record-ID", F.concat(F.lit("<"), record_id, F.lit(">"))), ("WARC-Date", F.lit(FIXED_DATE)), *more, ("Content-Length", F.octet_length(block).cast("string"))]
    lines = [F.when(v.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{k}: "), v, F.lit(END))) for k, v in head]
    return F.concat(F.lit(f"WARC/1.1{END}"), *lines, F.lit(END), block)


def write_archives(pages: DataFrame, path: str, compressed: bool = False) -> int:
    """Writes a capture for each row (page_id, url, html; null html: empty). Equal payloads: the smallest page_id's is the response.

    A null page_id counts as larger than any. Line ends in a url are percent-encoded; a null url has no header. Rows
    that repeat the smallest page_id of their payload are responses each. Returns the number of records.
    """
    bounded_batches(pages.sparkSession)
    fs, root = opened(path)
    fs.create_dir(root, recursive=True)
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    url = F.regexp_replace(F.regexp_replace(F.col("url").cast("string"), "\r", "%0D"), "\n", "%0A")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), payload.alias("payload")).withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    same = ["digest", "length", "check"]
    rows = rows.withColumns({"length": F.octet_length("payload"), "check": F.xxhash64("payload")})
    repeated = rows.groupBy(*same).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(*same, "first")
    repeated = stored(repeated, "warc-repeated")
    marked = rows.join(small(repeated, 64), same, "left").withColumn("capture", F.monotonically_increasing_id())
    name = lambda kind, c: F.concat(F.lit("urn:capture:"), c.cast("string"), F.lit(f":{kind}"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    own = name("response", F.concat(F.col("capture").cast("string"), F.lit(":page:"), page))
    link = ("WARC-Concurrent-To", F.concat(F.lit("<"), own, F.lit(">")))
    uri, digest = ("WARC-Target-URI", F.col("url")), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    size = F.octet_length("payload").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), size, F.lit(END + END))
    kind = ("Content-Type", F.lit("application/http;msgtype=response"))
    response = _record("response", own, F.concat(http, F.col("payload")), uri, kind, digest)
    refers = F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))
    revisit = _record("revisit", own, http, uri, kind, digest, ("WARC-Profile", F.lit(REVISIT)), ("WARC-Refers-To", refers))
    again = F.col("first").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("first"), F.lit(False))
    target = F.coalesce(F.nullif(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    request = _record("request", name("request", F.col("capture")), F.concat(F.lit("GET "), target, F.lit(f" HTTP/1.1{END}Host: "), host, F.lit(END + END)), link, uri, ("Content-Type", F.lit("application/http;msgtype=request")))
    notes = F.concat(F.lit("page-id: "), page, F.lit(f"{END}payload-length: "), size, F.lit(END))
    metadata = _record("metadata", name("metadata", F.col("capture")), notes, link, uri, ("Content-Type", F.lit("application/warc-fields")))
    each = marked.select(request.alias("request"), F.when(again, revisit).otherwise(response).alias("response"), metadata.alias("metadata"))
    return each.mapInArrow(_writing(path, compressed), "records long").agg(F.sum("records")).first()[0] or 0


def _writing(folder: str, compressed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = opened(folder)
        part, number, n, held, stream = TaskContext.get().partitionId(), 0, 0, "", None

        def end() -> None:
            nonlocal number, stream
            stream.close()
            fs.move(held, f"{root}/part-{part:06d}-{number:04d}.warc{'.gz' if compressed else ''}")  # an attempt that repeats a task replaces equal files
            number, stream = number + 1, None

        try:
            for batch in batches:
                for capture in zip(*(column(batch, c) for c in ("request", "response", "metadata")), strict=True):
                    if stream is None:
                        held = f"{root}/_held-{uuid.uuid4().hex}"
                        stream = fs.open_output_stream(held)
                    for record in capture:
                        data = record.as_py().encode() + b"\r\n\r\n"
                        stream.write(gzip.compress(data, mtime=0) if compressed else data)
                        n += 1
                    if stream.tell() >= FILE_BYTES:
                        end()
            if stream is not None:
                end()
        except BaseException:
            if stream is not None:  # what a failed attempt began is removed
                stream.close()
                fs.delete_file(held)
            raise
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["records"])

    return run


def records_of(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names, and the version as "") and block of each record, one at a time."""
    while version := stream.readline():
        fields = {"": version.decode().strip()}
        while (line := stream.readline().decode().rstrip(END)) != "":
            k, _, v = line.partition(":")
            fields[k.strip().lower()] = v.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        yield fields, block


def _row(head: dict[str, str], block: bytes, payloads: bool) -> dict:
    row = {"record_id": head["warc-record-id"].strip("<>"), "type": head["warc-type"], "target_uri": head.get("warc-target-uri")}
    for k in ("concurrent-to", "refers-to"):
        row[k.replace("-", "_")] = head[f"warc-{k}"].strip("<>") if f"warc-{k}" in head else None
    row["payload_digest"] = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if row["type"] == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        row["payload_bytes"] = len(payload)
        row["digest_ok"] = base64.b32encode(hashlib.sha1(payload).digest()).decode() == row["payload_digest"]
        row["payload"] = payload.decode() if payloads else None
    if row["type"] == "metadata":
        row["fields"] = [(k, v) for k, _, v in (x.partition(": ") for x in block.decode().split(END) if x)]
    return row


def _read(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in column(batch, "path").to_pylist():
                fs, name = opened(path)
                with fs.open_input_file(name) as f, gzip.GzipFile(fileobj=f) if name.endswith(".gz") else io.BufferedReader(f, 1 << 20) as stream:
                    rows, size = [], 0
                    for head, block in records_of(stream):
                        rows.append(_row(head, block, payloads))
                        size += 500 + (len(block) if payloads else 0)
                        if size >= READ_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    return run


_SCHEMA = pa.schema([(n, pa.map_(pa.string(), pa.string()) if n == "fields" else pa.int64() if n == "payload_bytes" else pa.bool_() if n == "digest_ok" else pa.string()) for n in re.findall(r"(\w+) (?:string|long|boolean|map)", RECORDS)])


def read_records(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row a record of the archives under path; the payload's text only if asked for."""
    bounded_batches(spark)
    paths = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path")  # no content is read here
    return stored(paths.mapInArrow(_read(payloads), RECORDS), "warc-records")


def captures(records: DataFrame) -> DataFrame:
    """Transaction assembly: one nested row a capture, its records joined through concurrent-to; records without one are captures themselves."""
    whole = F.struct(*[c for c in records.columns if c != "concurrent_to"])
    of = lambda *kinds: F.max_by(F.when(F.col("type").isin(*kinds), F.col("_record")), F.when(F.col("type").isin(*kinds), F.col("record_id")))
    keyed = records.withColumn("_record", whole).withColumn("capture", F.coalesce("concurrent_to", "record_id"))
    return keyed.groupBy("capture").agg(of("request").alias("request"), of("response", "revisit").alias("response"), of("metadata").alias("metadata"), F.count("*").alias("n_records"))


def page_captures(pages: DataFrame) -> DataFrame:
    """Writes archives for all pages, reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to, digest_ok, n_records.

    A null html is empty, and a null page_id counts as larger than any. Rows that tie for the smallest page_id of a payload are
    responses each. A very large page makes one large record, held whole by one task. Other columns are ignored, whatever their
    names. An empty table has no archive and gives no row.
    """
    path = new_path(pages.sparkSession, "warc")
    # Without an archive there is no file to read a schema's rows from.
    records = read_records(pages.sparkSession, path) if write_archives(pages, path) else pages.sparkSession.createDataFrame([], RECORDS)
    c = captures(records)
    number = lambda x, p: F.expr(f"try_cast(nullif(regexp_extract({x}, '{p}', 1), '') as long)")
    return c.select(
        number("response.record_id", ":page:(-?[0-9]+):").alias("page_id"),
        F.coalesce("response.payload_bytes", F.col("metadata.fields")["payload-length"].cast("long")).alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        number("response.refers_to", "^urn:page:(-?[0-9]+)").alias("refers_to"),
        F.col("response.digest_ok").alias("digest_ok"),
        "n_records",
    )
