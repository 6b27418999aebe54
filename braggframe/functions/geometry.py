"""Vectors as triples of Columns: distances, angles, dihedrals, transforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def xyz(prefix: str, suffix: str = "") -> Vec:
    return tuple(F.col(f"{prefix}{c}{suffix}") for c in "xyz")


def minus(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def dist2(a: Vec, b: Vec) -> Column:
    d = minus(a, b)
    return dot(d, d)


def angle(a: Vec, b: Vec, c: Vec) -> Column:
    """The angle at b, in radians; null where a place is."""
    u, v = minus(a, b), minus(c, b)
    cos = dot(u, v) / F.sqrt(dot(u, u) * dot(v, v))
    return F.when(cos.isNotNull(), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))  # greatest and least pass over nulls


def dihedral(a: Vec, b: Vec, c: Vec, d: Vec) -> Column:
    """The torsion about b-c, in radians, -pi to pi; null where a point is missing."""
    u, v, w = minus(b, a), minus(c, b), minus(d, c)
    m, n = cross(u, v), cross(v, w)
    return F.atan2(dot(u, n) * F.sqrt(dot(v, v)), dot(m, n))


def chiral_volume(centre: Vec, a: Vec, b: Vec, c: Vec) -> Column:
    return dot(minus(a, centre), cross(minus(b, centre), minus(c, centre)))


def angle_difference(a: Column, b: Column, full: float = 360.0) -> Column:
    d = F.abs(a - b) % full
    return F.least(d, full - d)


def transformed(rot, tran, p: Vec) -> Vec:
    """rot and tran: Columns or numbers, row by row."""
    return tuple(sum((r[j] * p[j] for j in range(1, 3)), r[0] * p[0]) + t for r, t in zip(rot, tran, strict=True))
