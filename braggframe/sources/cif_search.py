"""Search for one tag in CIF files without making their other items: the reader keeps to lines where it can.

A line of a loop's body that has no quotes, comments or names is cut at its blanks and counted; only other lines are taken token
by token. Values of other tags are never made into rows, so a search costs little more than reading the lines.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .cif import CifError

FOUND = "path string, block_idx int, block string, frame string, tag string, row_idx int, value_raw string, line_no int, _parse_error string"
#: Tokens of one line; a quote ends before a blank.
_TOKEN = re.compile(r"""\#.*|'(?:[^']|'(?=\S))*'(?=\s|\Z)|"(?:[^"]|"(?=\S))*"(?=\s|\Z)|\S+""")
_SLOW = re.compile(r"""['"#]|(?:^|\s)(?:_|data_|loop_|save_|global_|stop_)""", re.I)
_NAMES = ("data_", "save_", "global_")
BATCH = 20_000


def found_values(lines: Iterator[str], tag: str) -> Iterator[tuple]:
    """(block_idx, block, frame, tag, row_idx, value_raw, line_no) of a tag, whatever its case, in the order of the file."""
    low = tag.lower()
    block_idx, block, frame = -1, None, None
    pending: str | None = None  # a pair's tag that waits for its value
    header: list[str] | None = None  # tags of a loop whose values have not begun
    width = n = first = 0  # of a loop: how many tags, how many values so far, its line
    hits: set[int] = set()  # its columns that are searched for
    names: list[str] = []
    number = 0

    def ended() -> None:
        if width and n % width:
            raise CifError(f"a loop of {width} tags has {n} values", first)

    def value(text: str, line: int) -> tuple | None:
        nonlocal pending, header, width, n, hits, names
        if pending is not None:
            of, pending = pending, None
            return (block_idx, block, frame, of, 0, text, line) if of.lower() == low else None
        if header is not None:
            if not header:
                raise CifError("a loop has no tags", first)
            names, header = header, None
            width, n, hits = len(names), 0, {i for i, x in enumerate(names) if x.lower() == low}
        if not width:
            raise CifError(f"unexpected {text[:20]}", line)
        column, n = n % width, n + 1
        return (block_idx, block, frame, names[column], (n - 1) // width, text, line) if column in hits else None

    def over(line: int) -> None:
        nonlocal width, header
        if pending is not None:
            raise CifError(f"{pending} has no value", line)
        ended()
        width, header = 0, None

    for raw in lines:
        number += 1
        text = raw.rstrip("\r\n")
        if text[:1] == ";":
            begun, parts = number, [text]
            for raw in lines:
                number += 1
                parts.append(raw.rstrip("\r\n"))
                if parts[-1][:1] == ";" and (len(parts[-1]) == 1 or parts[-1][1].isspace()):
                    break
            else:
                raise CifError("a text field does not end", begun)
            if block is None:
                raise CifError("a block was expected, not a text field", begun)
            if row := value("\n".join([*parts[:-1], ";"]), begun):
                yield row
            rest = parts[-1][1:]
            if not rest.strip():
                continue
            text = " " + rest
        if width and not _SLOW.search(text):
            # The body of a loop, and nothing but plain values.
            cut = text.split()
            if hits:
                for k in hits:
                    for at in range((k - n) % width, len(cut), width):
                        yield block_idx, block, frame, names[k], (n + at) // width, cut[at], number
            n += len(cut)
            continue
        for m in _TOKEN.finditer(text):
            t = m[0]
            if t[0] == "#":
                break
            if t[0] in "'\"" and (len(t) < 2 or t[-1] != t[0]):
                raise CifError("a quote does not end", number)
            small = t[:7].lower()
            if t[0] == "_":
                if pending is not None:
                    raise CifError(f"{pending} has no value", number)
                if block is None:
                    raise CifError(f"a block was expected, not {t[:20]}", number)
                if header is not None:
                    header.append(t)
                else:
                    over(number)
                    pending = t
            elif small.startswith(_NAMES):
                over(number)
                if small.startswith("save_"):
                    frame = t[5:] or None
                else:
                    block_idx, block, frame = block_idx + 1, t[5:] if small.startswith("data_") else "", None
            elif small == "loop_" and len(t) == 5:
                over(number)
                if block is None:
                    raise CifError("a block was expected, not loop_", number)
                header, first = [], number
            elif small == "stop_" and len(t) == 5:
                over(number)
            else:
                if block is None:
                    raise CifError(f"a block was expected, not {t[:20]}", number)
                if row := value(t, number):
                    yield row
    over(number)


def _searching(tag: str, first_only: bool):
    names = [x.strip().split(" ")[0] for x in FOUND.split(",")]
    kinds = [pa.int32() if x.strip().endswith(" int") else pa.string() for x in FOUND.split(",")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for path, content in zip(files.column(0).to_pylist(), files.column(1), strict=True):
                rows: list[tuple] = []
                try:
                    plain = io.BytesIO(content.as_buffer())
                    stream = gzip.GzipFile(fileobj=plain) if path.endswith(".gz") else plain
                    for row in found_values(io.TextIOWrapper(stream, "utf-8", "replace", newline="\n"), tag):
                        rows.append((path, *row, None))
                        if first_only:
                            break
                        if len(rows) == BATCH:
                            yield batch(rows)
                            rows = []
                except CifError as e:
                    rows.append((path, *[None] * 6, e.line, str(e)))
                except (OSError, EOFError) as e:
                    rows.append((path, *[None] * 7, str(e)))
                if rows:
                    yield batch(rows)

    return run


def search_tag(spark: SparkSession, path: str, tag: str, first_only: bool = False, glob: str = "*.cif*") -> DataFrame:
    """Values of a tag in the CIF files (gzipped too) under a path: path, block_idx, block, frame, tag, row_idx, value_raw, line_no.

    first_only: the first value of each file, after which the file is not read on. A file that does not parse ends with a row
    that says why in _parse_error.
    """
    from ..session import ship_package

    ship_package(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInArrow(_searching(tag, first_only), FOUND)
