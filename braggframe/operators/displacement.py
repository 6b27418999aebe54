"""Displacement tensors of atoms, the standard frame of a crystal, extents of grids, and comparisons of distributions."""

from __future__ import annotations

from math import pi

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cell import Cell

U = ("u11", "u22", "u33", "u12", "u13", "u23")
_AT = {(0, 0): 0, (1, 1): 1, (2, 2): 2, (0, 1): 3, (0, 2): 4, (1, 2): 5}


def _entry(u: list[Column], i: int, j: int) -> Column:
    return u[_AT[min(i, j), max(i, j)]]


def with_tensors(atoms: DataFrame, all_atoms: bool = False) -> DataFrame:
    """Atoms without a tensor (all_atoms: every one) get the isotropic one of their B: B / 8 pi squared on the diagonal."""
    iso = F.col("b_iso") / (8 * pi * pi)
    for i, c in enumerate(U):
        made = iso if i < 3 else F.lit(0.0)
        atoms = atoms.withColumn(c, made if all_atoms or c not in atoms.columns else F.when(F.col("u11").isNull(), made).otherwise(F.col(c)) if c != "u11" else F.col(c))
    return atoms.withColumn("u11", F.coalesce("u11", iso)) if not all_atoms else atoms


def without_tensors(atoms: DataFrame) -> DataFrame:
    """B from the tensor, where there is one: 8 pi squared times its mean diagonal; the tensor goes."""
    b = 8 * pi * pi * (F.col("u11") + F.col("u22") + F.col("u33")) / 3
    return atoms.withColumn("b_iso", F.coalesce(b, "b_iso")).drop(*U)


def moved_with_tensors(atoms: DataFrame, rot: list[list[float]], tran: list[float]) -> DataFrame:
    """Positions and tensors under a rotation and a shift: R x + t and R U R'."""
    x, u = [F.col(c) for c in "xyz"], [F.col(c) for c in U]
    place = [sum((F.lit(float(rot[i][j])) * x[j] for j in (1, 2)), F.lit(float(rot[i][0])) * x[0]) + float(tran[i]) for i in range(3)]
    turned = {}
    for (i, j), n in _AT.items():
        terms = [F.lit(float(rot[i][a]) * float(rot[j][b])) * _entry(u, a, b) for a in range(3) for b in range(3) if rot[i][a] * rot[j][b]]
        turned[U[n]] = sum(terms[1:], terms[0]) if terms else F.lit(0.0)
    return atoms.withColumns(dict(zip("xyz", place, strict=True)) | turned)


def principal_ratio(atoms: DataFrame) -> DataFrame:
    """Adds b_eq and the ratio of the tensor's least to its greatest eigenvalue, by the closed form of a symmetric matrix."""
    a, b, c, d, e, f = (F.col(x) for x in U)
    q = (a + b + c) / 3
    p2 = ((a - q) * (a - q) + (b - q) * (b - q) + (c - q) * (c - q) + 2 * (d * d + e * e + f * f)) / 6
    p = F.sqrt(p2)
    det = (a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / (2 * p2 * p)))) / 3
    most, least = q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + 2 * pi / 3)
    return atoms.withColumns({"b_eq": 8 * pi * pi * q, "ratio": F.when(p2 < 1e-20, 1.0).otherwise(least / most)})


def in_standard_frame(atoms: DataFrame, cell: Cell, scale: np.ndarray, shift: np.ndarray) -> DataFrame:
    """Atoms whose file states another orthogonal frame (its matrix and shift to fractions) moved into the standard one of the cell."""
    m = cell.orth @ np.asarray(scale, float)
    t = cell.orth @ np.asarray(shift, float)
    x = [F.col(c) for c in "xyz"]
    new = [sum((float(m[i][j]) * x[j] for j in (1, 2)), float(m[i][0]) * x[0]) + float(t[i]) for i in range(3)]
    return atoms.withColumns(dict(zip("xyz", new, strict=True)))


def with_children(parents: DataFrame, children: DataFrame, keys: list[str]) -> DataFrame:
    """Chains, residues or models that still have something in them: the others go."""
    return parents.join(children.select(*keys).distinct(), keys, "left_semi")


def nonzero_extent(grid: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    """Along each axis the shortest run of points, across the cell's edge if need be, outside of which all values are 0: axis, first, last.

    It ends where the longest run of empty planes begins. Planes are at most as many as the axis has points.
    """
    lit = grid.where("value is not null and value <> 0")
    out = None
    for axis, n in zip("uvw", size, strict=True):
        planes = lit.select(F.col(axis).alias("at")).distinct()
        w = W.orderBy("at")  # at most n planes
        gaps = planes.withColumn("_next", F.lead("at").over(w)).withColumn("_first", F.min("at").over(W.partitionBy()))
        gaps = gaps.select("at", F.coalesce("_next", F.col("_first") + n).alias("next"))
        widest = gaps.groupBy().agg(F.max_by(F.struct("at", "next"), F.struct(F.col("next") - F.col("at"), -F.col("at"))).alias("g")).where("g is not null")
        first = (F.col("g.next") % n).cast("int")
        length = F.lit(n) - (F.col("g.next") - F.col("g.at"))
        part = widest.select(F.lit(axis).alias("axis"), first.alias("first"), (first + length).cast("int").alias("last"))
        out = part if out is None else out.unionByName(part)
    return out


def quantile_pairs(a: DataFrame, b: DataFrame, x: str, n: int) -> DataFrame:
    """A row for each of n + 1 quantiles of two samples, for a plot of one against the other: q, first, second."""
    qs = [i / n for i in range(n + 1)]
    one = lambda df, name: df.agg(F.percentile(x, F.array(*map(F.lit, qs))).alias(name))
    both = one(a, "a").crossJoin(F.broadcast(one(b, "b")))  # one row each
    return both.select(F.posexplode(F.arrays_zip("a", "b")).alias("i", "p")).select((F.col("i") / n).alias("q"), F.col("p.a").alias("first"), F.col("p.b").alias("second"))


def relative_deviation(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Mean absolute deviation from the mean, by the mean: keys, n, rmad."""
    mean = df.groupBy(*keys).agg(F.avg(x).alias("_mean"))
    near = df.join(mean, keys)
    return near.groupBy(*keys).agg(F.count("*").alias("n"), (F.avg(F.abs(F.col(x) - F.col("_mean"))) / F.first("_mean")).alias("rmad"))


def conforms(items: DataFrame, dictionaries: DataFrame) -> DataFrame:
    """Blocks' audit records against known dictionaries (dict_name, dict_version): path, block_idx, dict_name, dict_version, status.

    status: same, older, newer (versions compared number by number), unknown (no such dictionary) or unstated (no record).
    """
    from .cif_query import BLOCK, category

    stated = category(items, "audit_conform", ["dict_name", "dict_version"]).drop("row_idx")
    known = dictionaries.select("dict_name", F.col("dict_version").alias("_known"))
    numbers = lambda c: F.transform(F.regexp_extract_all(F.col(c), F.lit(r"(\d+)"), 1), lambda v: v.cast("int"))
    j = items.select(*BLOCK).distinct().join(stated, BLOCK, "left").join(known, "dict_name", "left")
    status = F.when(F.col("dict_name").isNull(), "unstated").when(F.col("_known").isNull(), "unknown").when(numbers("dict_version") < numbers("_known"), "older").when(numbers("dict_version") > numbers("_known"), "newer").otherwise("same")
    return j.select("path", "block_idx", "dict_name", "dict_version", status.alias("status"))
