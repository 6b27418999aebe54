"""CIF documents as rows: a tokenizer, a data source, and a writer.

spark.read.format("cif").load(folder) gives the items of every file, one row a value: path, block_idx, block, frame,
item_idx, kind (pair, loop or comment), category, tag, row_idx, col_idx, value_raw, line_no, and _parse_error for files
that do not parse. Options: oneBlock (stop after the first), pathGlob. A file is one task: its state runs from end to end.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ITEMS = (
    "path string, block_idx int, block string, frame string, item_idx int, kind string, category string, tag string, "
    "row_idx int, col_idx int, value_raw string, line_no int, _parse_error string"
)
_TOKEN = re.compile(r"""(?:^|(?<=\n));.*?(?:\r?\n;(?=\s|\Z))|\#[^\n]*|'(?:[^'\n]|'(?=\S))*'(?=\s|\Z)|"(?:[^"\n]|"(?=\S))*"(?=\s|\Z)|\S+""", re.S)


class CifError(ValueError):
    def __init__(self, message: str, line: int):
        super().__init__(f"line {line}: {message}")
        self.line = line


def tokens(text: str) -> Iterator[tuple[str, int]]:
    """Tokens with their lines; comments are left out."""
    line, at = 1, 0
    for m in _TOKEN.finditer(text):
        line += text.count("\n", at, m.start())
        at = m.start()
        t = m[0]
        if t[0] == "#":
            continue
        if t[0] == ";" and (m.start() == 0 or text[m.start() - 1] == "\n") and not re.search(r"\n;\Z", t):
            raise CifError("a text field does not end", line)
        if t[0] in "'\"" and (len(t) < 2 or t[-1] != t[0]):
            raise CifError("a quote does not end", line)
        yield t, line


def _category(tag: str) -> str:
    return tag[1:].split(".", 1)[0] if "." in tag else ""


def parse_cif(text: str, one_block: bool = False) -> Iterator[tuple]:
    """Rows (block_idx, block, frame, item_idx, kind, category, tag, row_idx, col_idx, value_raw, line_no)."""
    block_idx, block, frame, item = -1, None, None, -1
    stream = iter([*tokens(text), ("", 0)])
    t, line = next(stream)
    while t:
        low = t.lower()
        if low.startswith("data_"):
            if one_block and block_idx == 0:
                return
            block_idx, block, frame, item = block_idx + 1, t[5:], None, -1
            yield block_idx, block, None, -1, "block", None, None, None, None, None, line
            t, line = next(stream)
        elif low.startswith("global_"):
            block_idx, block, frame, item = block_idx + 1, "", None, -1
            t, line = next(stream)
        elif block is None:
            raise CifError(f"a block was expected, not {t[:20]}", line)
        elif low.startswith("save_"):
            frame = t[5:] or None
            t, line = next(stream)
        elif low == "loop_":
            item += 1
            tags, n, first = [], 0, line
            t, line = next(stream)
            while t.startswith("_"):
                tags.append((t, line))
                t, line = next(stream)
            if not tags:
                raise CifError("a loop has no tags", first)
            while t and not t.startswith("_") and not re.match(r"(data_|save_|loop_$|global_$|stop_$)", t, re.I):
                yield block_idx, block, frame, item, "loop", _category(tags[n % len(tags)][0]), tags[n % len(tags)][0], n // len(tags), n % len(tags), t, line
                n += 1
                t, line = next(stream)
            if t.lower() == "stop_":
                t, line = next(stream)
            if n % len(tags):
                raise CifError(f"a loop of {len(tags)} tags has {n} values", first)
            if not n:
                for i, (tag, at) in enumerate(tags):
                    yield block_idx, block, frame, item, "empty_loop", _category(tag), tag, None, i, None, at
        elif t.startswith("_"):
            tag, at = t, line
            t, line = next(stream)
            if not t or t.startswith("_") or re.match(r"(data_|save_|loop_$|global_$)", t, re.I):
                raise CifError(f"{tag} has no value", at)
            item += 1
            yield block_idx, block, frame, item, "pair", _category(tag), tag, 0, 0, t, at
            t, line = next(stream)
        else:
            raise CifError(f"unexpected {t[:20]}", line)


def _file_items(path: str, content: bytes, one_block: bool) -> Iterator[pa.RecordBatch]:
    """Batches of a file's items; a file that does not parse ends with a row that says why."""
    names = [x.strip().split(" ")[0] for x in ITEMS.split(",")]
    kinds = [pa.int32() if x.strip().endswith(" int") else pa.string() for x in ITEMS.split(",")]
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    try:
        text = (gzip.decompress(content) if path.endswith(".gz") else content).decode("utf-8", "replace")
        for row in parse_cif(text, one_block):
            rows.append((path, *row, None))
            if len(rows) == 50_000:
                yield batch()
                rows = []
    except CifError as e:
        rows.append((path, *[None] * 10, e.line, str(e)))
    except (OSError, EOFError) as e:
        rows.append((path, *[None] * 10, None, str(e)))
    if rows:
        yield batch()


def _items(one_block: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from _file_items(path, content, one_block)

    return run


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class CifSource(DataSource):
    """spark.read.format("cif").load(folder or file). Options: oneBlock, pathGlob. A file is a partition."""

    @classmethod
    def name(cls):
        return "cif"

    def schema(self):
        return ITEMS

    def reader(self, schema):
        return _CifReader(self.options)


class _CifReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.one = options["path"], options.get("oneBlock", "false").lower() == "true"
        self.glob = options.get("pathGlob", "*.cif*")

    def partitions(self):
        import fnmatch
        import posixpath

        import pyarrow.fs as pafs

        from .binary import _file

        fs, root = _file(self.path)
        if fs.get_file_info(root).type == pafs.FileType.File:
            return [_File(root)]
        found = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.is_file and fnmatch.fnmatch(posixpath.basename(f.path), self.glob))
        return [_File(p) for p in found] or [_File("")]

    def read(self, partition):
        from .binary import _file

        if partition.path:
            fs, _ = _file(self.path)
            with fs.open_input_file(partition.path) as f:
                yield from _file_items(partition.path, f.read(), self.one)


def read_cif(spark: SparkSession, path: str, one_block: bool = False, glob: str = "*.cif*", recursive: bool = True) -> DataFrame:
    """Items of the CIF files (gzipped too) under a path."""
    from ..session import ship_package

    ship_package(spark)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return files.select("path", "content").mapInArrow(_items(one_block), ITEMS)


def validated(items: DataFrame) -> DataFrame:
    """A row a file: whether it parsed, and the first message with its line."""
    return items.groupBy("path").agg((F.count("_parse_error") == 0).alias("ok"), F.min("_parse_error").alias("message"), F.min(F.when(F.col("_parse_error").isNotNull(), F.col("line_no"))).alias("line"))


def read_mmjson(spark: SparkSession, path: str) -> DataFrame:
    """The same items from mmJSON files: {"data_X": {category: {column: [values]}}}; null is '?'."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", "map<string,map<string,map<string,array<string>>>>").alias("doc"))
    blocks = whole.select("path", F.explode("doc").alias("block", "categories"))
    cats = blocks.select("path", F.regexp_replace("block", "^data_", "").alias("block"), F.explode("categories").alias("category", "columns"))
    cols = cats.select("path", "block", "category", F.explode("columns").alias("name", "vals"))
    return cols.select("path", "block", "category", F.concat(F.lit("_"), "category", F.lit("."), "name").alias("tag"), F.posexplode("vals").alias("row_idx", "v")).withColumn("value_raw", F.coalesce("v", F.lit("?"))).drop("v")


def to_cif_text(items: DataFrame) -> DataFrame:
    """A row a block (path, block, text): its items written again, pairs and loops in order, frames left out."""
    v = F.struct("item_idx", "row_idx", "col_idx", "kind", "tag", "value_raw")

    def write(rows: list) -> str:
        out: list[str] = []
        rows = sorted(rows, key=lambda r: (r["item_idx"], r["row_idx"] or 0, r["col_idx"] or 0))
        i = 0
        while i < len(rows):
            j = i
            while j < len(rows) and rows[j]["item_idx"] == rows[i]["item_idx"]:
                j += 1
            group = rows[i:j]
            if group[0]["kind"] == "pair":
                value = group[0]["value_raw"]
                out.append(f"{group[0]['tag']}{chr(10) if value.startswith(';') else ' '}{value}")
            elif group[0]["kind"] in ("loop", "empty_loop"):
                tags = [r["tag"] for r in group if not r["row_idx"]]
                out += ["loop_", *tags]
                for k in range(0, len(group), len(tags)):
                    if group[k]["value_raw"] is not None:
                        line = ""
                        for r in group[k : k + len(tags)]:
                            line += f"\n{r['value_raw']}\n" if r["value_raw"].startswith(";") else ("" if not line or line.endswith("\n") else " ") + r["value_raw"]
                        out.append(line.strip("\n") if not line.startswith("\n") else line[1:].rstrip("\n"))
            i = j
        return "\n".join(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [f"data_{b}\n{write(r)}\n" for b, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts)], ["path", "block", "text"])

    grouped = items.where("kind <> 'block' and frame is null").groupBy("path", "block").agg(F.collect_list(v).alias("rows"))  # a block is one file's
    return grouped.mapInArrow(run, "path string, block string, text string")


def to_mmjson(items: DataFrame) -> DataFrame:
    """A row a block (path, block, json) in the mmJSON layout; ? and . are null."""
    from ..functions.values import cif_string, is_null

    value = F.when(is_null(F.col("value_raw")), None).otherwise(cif_string(F.col("value_raw")))
    cols = items.where("value_raw is not null and frame is null and tag like '%.%'").groupBy("path", "block", "category", "tag").agg(F.transform(F.sort_array(F.collect_list(F.struct("row_idx", value.alias("v")))), lambda x: x["v"]).alias("vals"))
    cats = cols.groupBy("path", "block", "category").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.split_part("tag", F.lit("."), F.lit(2)), "vals")))).alias("columns"))
    blocks = cats.groupBy("path", "block").agg(F.map_from_entries(F.sort_array(F.transform(F.collect_list(F.struct("category", F.to_json("columns").alias("j"))), lambda x: F.struct(x["category"].alias("k"), x["j"].alias("v"))))).alias("cats"))
    return blocks.select("path", "block", F.concat(F.lit('{"data_'), "block", F.lit('":{'), F.array_join(F.transform(F.map_entries("cats"), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ","), F.lit("}}")).alias("json"))
