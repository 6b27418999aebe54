"""Binary reflection and map files: MTZ and CCP4/MRC readers and writers, XDS text."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS_A_TASK = 1 << 20


def parse_mtz_header(records: bytes) -> dict:
    """Columns, cell, space group, symmetry triplets, datasets, sort order and history from the 80-character records."""
    out: dict = {"columns": [], "symops": [], "datasets": [], "history": [], "batches": [], "resolution": None}
    lines = [records[i : i + 80].decode("latin-1").rstrip() for i in range(0, len(records), 80)]
    history = False
    for line in lines:
        key, _, rest = line.partition(" ")
        rest = rest.strip()
        if history and key not in ("MTZENDOFHEADERS", "MTZBATS"):
            out["history"].append(line)
        elif key == "NCOL":
            out["ncol"], out["nrefl"], out["nbatch"] = map(int, rest.split()[:3])
        elif key == "CELL":
            out["cell"] = [float(x) for x in rest.split()[:6]]
        elif key == "SORT":
            out["sort"] = [int(x) for x in rest.split()]
        elif key == "SYMINF":
            out["spacegroup"] = rest.split("'")[1] if "'" in rest else ""
        elif key == "SYMM":
            out["symops"].append(rest)
        elif key == "RESO":
            out["resolution"] = [float(x) for x in rest.split()[:2]]
        elif key.startswith("COL") and key == "COLUMN":
            p = rest.split()
            out["columns"].append({"label": p[0], "type": p[1], "dataset": int(p[4]) if len(p) > 4 else 0})
        elif key in ("PROJECT", "CRYSTAL", "DATASET", "DCELL", "DWAVEL"):
            out["datasets"].append((key, rest))
        elif key == "MTZHIST":
            history = True
        elif key == "MTZBATS":
            history = False
    return out


def mtz_header(data: bytes) -> dict:
    if data[:4] != b"MTZ ":
        raise ValueError("not an MTZ file")
    order = "<" if data[9] >> 4 == 4 or data[8] >> 4 == 4 else ">"
    at = struct.unpack(order + "i", data[4:8])[0]
    if at == -1:
        at = struct.unpack(order + "q", data[12:20])[0]
    head = parse_mtz_header(data[4 * (at - 1) :])
    return head | {"order": order}


class _Rows(InputPartition):
    def __init__(self, path: str, first: int, n: int, order: str, columns: list[str], missing: bool):
        self.path, self.first, self.n, self.order, self.columns, self.missing = path, first, n, order, columns, missing


def _file(path: str):
    import os

    import pyarrow.fs as pafs

    fs, p = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")
    return fs, p


class MtzSource(DataSource):
    """spark.read.format("mtz").load(file): row, then the columns as floats, h, k, l as integers. Rows are of fixed width, so a file is many tasks."""

    @classmethod
    def name(cls):
        return "mtz"

    def _header(self):
        fs, p = _file(self.options["path"])
        with fs.open_input_file(p) as f:
            return mtz_header(f.read())

    def schema(self):
        names = [c["label"] for c in self._header()["columns"]]
        return "row long, " + ", ".join(f"`{n.lower() if n in 'HKL' else n}` {'int' if n in 'HKL' else 'float'}" for n in names)

    def reader(self, schema):
        return _MtzReader(self.options["path"], self._header())


class _MtzReader(DataSourceReader):
    def __init__(self, path, head):
        self.path, self.head = path, head

    def partitions(self):
        n, labels = self.head["nrefl"], [c["label"] for c in self.head["columns"]]
        return [_Rows(self.path, i, min(ROWS_A_TASK, n - i), self.head["order"], labels, False) for i in range(0, n, ROWS_A_TASK)] or [_Rows(self.path, 0, 0, "<", labels, False)]

    def read(self, part):
        fs, p = _file(part.path)
        with fs.open_input_file(p) as f:
            f.seek(80 + 4 * part.first * len(part.columns))
            data = np.frombuffer(f.read(4 * part.n * len(part.columns)), part.order + "f4").reshape(part.n, len(part.columns)).astype(np.float32)
        arrays = [pa.array(np.arange(part.first, part.first + part.n))]
        for i, c in enumerate(part.columns):
            arrays.append(pa.array(data[:, i].astype(np.int32)) if c in "HKL" else pa.array(data[:, i], from_pandas=True))
        yield pa.RecordBatch.from_arrays(arrays, ["row", *(c.lower() if c in "HKL" else c for c in part.columns)])


def mtz_bytes(columns: list[tuple[str, str]], rows: np.ndarray, cell: list[float], spacegroup: str, number: int, symops: list[str], title: str = "") -> bytes:
    """A merged MTZ file from labels with types and a table of floats, sorted by h, k, l."""
    rows = np.asarray(rows, "<f4")
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))] if len(rows) else rows
    body = rows.tobytes()
    head = [
        "VERS MTZ:V1.1", f"TITLE {title}", f"NCOL {len(columns):8d} {len(rows):12d} {0:8d}", "CELL  " + " ".join(f"{x:9.4f}" for x in cell), "SORT    1   2   3   0   0",
        f"SYMINF {len(symops):3d} {len(symops):2d} {spacegroup[0]} {number:5d} {chr(39) + spacegroup + chr(39):>22s} {'PG1':>5s}", *(f"SYMM {s.upper()}" for s in symops), "VALM NAN",
    ]
    for i, (label, kind) in enumerate(columns):
        v = rows[:, i][~np.isnan(rows[:, i])] if len(rows) else rows[:0]
        lo, hi = (float(v.min()), float(v.max())) if len(v) else (0.0, 0.0)
        head.append(f"COLUMN {label:30s} {kind} {lo:17.9g} {hi:17.9g} {0 if i < 3 else 1:4d}")
    head += ["NDIF        1", "PROJECT       1 project", "CRYSTAL       1 crystal", "DATASET       1 dataset", "DCELL         1 " + " ".join(f"{x:9.4f}" for x in cell), "DWAVEL        1    0.00000", "END", "MTZENDOFHEADERS"]
    at = 21 + len(body) // 4
    first = (b"MTZ " + struct.pack("<i", at) + b"\x44\x41\x00\x00").ljust(80, b"\0")
    return first + body + "".join(h[:80].ljust(80) for h in head).encode("latin-1")


def read_xds(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Header (key, value) and reflections (h, k, l, iobs, sigma, fields) of XDS_ASCII or INTEGRATE files, from text."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), F.col("value"))
    head = lines.where("value like '!%'").select("path", F.explode(F.regexp_extract_all("value", F.lit(r"([A-Z_0-9]+= *[^!]*?)(?= +[A-Z_0-9]+=|$)"), 1)).alias("kv"))
    head = head.select("path", F.split_part("kv", F.lit("="), F.lit(1)).alias("key"), F.trim(F.expr("substring(kv, instr(kv, '=') + 1)")).alias("value"))
    f = F.split(F.trim("value"), r"\s+")
    rows = lines.where("value not like '!%' and trim(value) <> ''").select("path", f.alias("fields"))
    at = lambda i: F.get("fields", F.lit(i))
    data = rows.select("path", at(0).cast("int").alias("h"), at(1).cast("int").alias("k"), at(2).cast("int").alias("l"), at(3).cast("double").alias("iobs"), at(4).cast("double").alias("sigma"), F.transform(F.slice("fields", 6, 100), lambda x: x.cast("double")).alias("fields"))
    return head, data


_MODES = {0: "i1", 1: "i2", 2: "f4", 6: "u2", 12: "f2"}


def ccp4_header(data: bytes) -> dict:
    order = "<" if data[212] in (0x44, 0) else ">"
    w = struct.unpack(order + "256i", data[:1024])
    f = struct.unpack(order + "256f", data[:1024])
    return {"order": order, "nc": w[0], "nr": w[1], "ns": w[2], "mode": w[3], "start": w[4:7], "grid": w[7:10], "cell": f[10:16], "axes": w[16:19], "stats": f[19:22], "spacegroup": w[22], "skip": 1024 + w[23]}


class _Sections(InputPartition):
    def __init__(self, first: int, n: int):
        self.first, self.n = first, n


class Ccp4Source(DataSource):
    """spark.read.format("ccp4").load(file): u, v, w (grid points along a, b, c) and value; a task reads some sections."""

    @classmethod
    def name(cls):
        return "ccp4"

    def schema(self):
        return "u int, v int, w int, value double"

    def reader(self, schema):
        return _Ccp4Reader(self.options["path"])


class _Ccp4Reader(DataSourceReader):
    def __init__(self, path):
        fs, p = _file(path)
        with fs.open_input_file(p) as f:
            self.head = ccp4_header(f.read(1024))
        self.path = path

    def partitions(self):
        h = self.head
        some = max(1, (1 << 22) // max(1, h["nc"] * h["nr"]))
        return [_Sections(i, min(some, h["ns"] - i)) for i in range(0, h["ns"], some)]

    def read(self, part) -> Iterator[pa.RecordBatch]:
        h = self.head
        kind = np.dtype(h["order"] + _MODES[h["mode"]])
        fs, p = _file(self.path)
        with fs.open_input_file(p) as f:
            f.seek(h["skip"] + kind.itemsize * h["nc"] * h["nr"] * part.first)
            data = np.frombuffer(f.read(kind.itemsize * h["nc"] * h["nr"] * part.n), kind).astype(np.float64)
        s, r, c = np.meshgrid(np.arange(part.first, part.first + part.n), np.arange(h["nr"]), np.arange(h["nc"]), indexing="ij")
        place = {}
        for axis, x, start in zip(h["axes"], (c, r, s), h["start"], strict=True):
            place[axis] = np.mod(x.ravel() + start, h["grid"][axis - 1]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(place[1]), pa.array(place[2]), pa.array(place[3]), pa.array(data)], ["u", "v", "w", "value"])


def ccp4_bytes(grid: np.ndarray, cell: list[float], spacegroup: int = 1) -> bytes:
    """A mode 2 map of a whole unit cell, grid indexed [u, v, w]."""
    nu, nv, nw = grid.shape
    words = np.zeros(256, "<i4")
    words[:10] = [nu, nv, nw, 2, 0, 0, 0, nu, nv, nw]
    words[10:16] = np.array(cell, "<f4").view("<i4")
    words[16:19] = [1, 2, 3]
    words[19:22] = np.array([grid.min(), grid.max(), grid.mean()], "<f4").view("<i4")
    words[22] = spacegroup
    words[52] = int.from_bytes(b"MAP ", "little")
    words[53] = 0x4144
    words[54] = np.array([grid.std()], "<f4").view("<i4")[0]
    return words.tobytes() + np.ascontiguousarray(grid.transpose(2, 1, 0), "<f4").tobytes()


def register(spark: SparkSession) -> None:
    from ..session import ship_package

    from .cif import CifSource

    ship_package(spark)
    for source in (MtzSource, Ccp4Source, CifSource):
        spark.dataSource.register(source)


def write_mtz(df: DataFrame, path: str, columns: list[tuple[str, str]], cell: list[float], spacegroup: str, number: int, symops: list[str]) -> int:
    """Writes h, k, l and columns (name, type) as one MTZ file; rows are sorted by Spark and stream through one task. Returns their number.

    The header stands at the end of such a file and its place at the start, so rows are counted first.
    """
    labels = [("H", "H"), ("K", "H"), ("L", "H"), *columns]
    ordered = df.select("h", "k", "l", *(F.col(c).cast("float").alias(c) for c, _ in columns)).orderBy("h", "k", "l")
    n = df.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = mtz_bytes(labels, np.zeros((0, len(labels))), cell, spacegroup, number, symops)
        at = 21 + n * len(labels)
        fs, p = _file(path)
        written = 0
        with fs.open_output_stream(f"{p}.part") as f:
            f.write((b"MTZ " + struct.pack("<i", at) + template[8:80])[:80])
            for b in batches:
                rows = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype("<f4") for i in range(b.num_columns)], axis=1)
                f.write(rows.tobytes())
                written += len(rows)
            head = template[80:].decode("latin-1")
            lines = [head[i : i + 80] for i in range(0, len(head), 80)]
            lines[2] = f"NCOL {len(labels):8d} {n:12d} {0:8d}".ljust(80)
            f.write("".join(lines).encode("latin-1"))
        fs.move(f"{p}.part", p)
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], ["n"])

    return ordered.coalesce(1).mapInArrow(run, "n long").first().n


def xds_observations(data: DataFrame, group) -> DataFrame:
    """XDS reflections in the layout of unmerged tables: asymmetric unit indices, M/ISYM, batch from the image number, I and sigma (misfits, of negative sigma, left out)."""
    a = data.where("sigma > 0").withColumn("_a", group.to_asu(F.col("h"), F.col("k"), F.col("l")))
    return a.select(*(F.col(f"_a.{c}").alias(c) for c in "hkl"), F.col("_a.isym").alias("isym"), F.floor(F.get("fields", F.lit(2))).cast("int").alias("batch"), F.col("iobs").alias("value"), "sigma")


def full_cell_map(grid: DataFrame, group, size: tuple[int, int, int]) -> DataFrame:
    """A map of an asymmetric unit expanded to the cell: the first operation's value wins where images meet."""
    from ..operators.grid import grid_images

    e = grid.select(F.col("value"), F.posexplode(grid_images(group, size)).alias("_op", "_p"))
    return e.groupBy("_p.u", "_p.v", "_p.w").agg(F.min_by("value", "_op").alias("value"))
