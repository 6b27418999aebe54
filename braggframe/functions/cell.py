"""Unit cells: constants on the driver, Column arithmetic for positions and resolution."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from math import cos, floor, pi, radians, sin, sqrt

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _cos(degrees: float) -> float:
    return 0.0 if degrees == 90 else cos(radians(degrees))


@dataclass(frozen=True)
class Cell:
    a: float
    b: float
    c: float
    alpha: float = 90.0
    beta: float = 90.0
    gamma: float = 90.0

    @cached_property
    def volume(self) -> float:
        x, y, z = map(_cos, (self.alpha, self.beta, self.gamma))
        return self.a * self.b * self.c * sqrt(1 - x * x - y * y - z * z + 2 * x * y * z)

    @cached_property
    def orth(self) -> np.ndarray:
        """Orthogonalization matrix of the PDB convention: a along x, c* along z."""
        ca, cb, cg = map(_cos, (self.alpha, self.beta, self.gamma))
        sg = 1.0 if self.gamma == 90 else sin(radians(self.gamma))
        return np.array([[self.a, self.b * cg, self.c * cb], [0, self.b * sg, self.c * (ca - cb * cg) / sg], [0, 0, self.volume / (self.a * self.b * sg)]])

    @cached_property
    def frac(self) -> np.ndarray:
        return np.linalg.inv(self.orth)

    @cached_property
    def metric(self) -> np.ndarray:
        return self.orth.T @ self.orth

    @cached_property
    def reciprocal_metric(self) -> np.ndarray:
        return np.linalg.inv(self.metric)

    def inv_d2(self, h: Column, k: Column, l: Column) -> Column:
        """1 / d squared of a reflection."""
        g = self.reciprocal_metric
        terms = [(h * h, g[0, 0]), (k * k, g[1, 1]), (l * l, g[2, 2]), (h * k, 2 * g[0, 1]), (h * l, 2 * g[0, 2]), (k * l, 2 * g[1, 2])]
        kept = [x * F.lit(float(c)) for x, c in terms if abs(c) > 1e-15]
        return sum(kept[1:], kept[0])

    def d(self, h: Column, k: Column, l: Column) -> Column:
        return 1 / F.sqrt(self.inv_d2(h, k, l))

    def stol2(self, h: Column, k: Column, l: Column) -> Column:
        return self.inv_d2(h, k, l) / 4

    def orthogonalized(self, x: Column, y: Column, z: Column) -> list[Column]:
        return _product(self.orth, x, y, z)

    def fractional(self, x: Column, y: Column, z: Column) -> list[Column]:
        return _product(self.frac, x, y, z)

    def hkl_limits(self, d_min: float) -> tuple[int, int, int]:
        return tuple(floor(x / d_min) for x in (self.a, self.b, self.c))

    def similar(self, other: Cell, relative: float, degrees: float) -> bool:
        lengths = all(abs(x - y) <= relative * max(x, y) for x, y in zip((self.a, self.b, self.c), (other.a, other.b, other.c), strict=True))
        return lengths and all(abs(x - y) <= degrees for x, y in zip((self.alpha, self.beta, self.gamma), (other.alpha, other.beta, other.gamma), strict=True))

    @staticmethod
    def from_metric(g: np.ndarray) -> Cell:
        a, b, c = np.sqrt(np.diag(g))
        angle = lambda x, u, v: float(np.degrees(np.arccos(x / (u * v))))
        return Cell(float(a), float(b), float(c), angle(g[1, 2], b, c), angle(g[0, 2], a, c), angle(g[0, 1], a, b))


def _product(m: np.ndarray, x: Column, y: Column, z: Column) -> list[Column]:
    out = []
    for row in m:
        kept = [v * F.lit(float(c)) for v, c in zip((x, y, z), row, strict=True) if abs(c) > 1e-15]
        out.append(sum(kept[1:], kept[0]) if kept else x * 0)
    return out


def niggli(cell: Cell, epsilon: float = 1e-9, limit: int = 100) -> tuple[Cell, int]:
    """The reduced cell by Krivy and Gruber's steps on the six scalar products, and the number of rounds."""
    m = cell.metric
    a, b, c, x, y, z = m[0, 0], m[1, 1], m[2, 2], 2 * m[1, 2], 2 * m[0, 2], 2 * m[0, 1]
    eps = epsilon * cell.volume ** (2 / 3)
    for n in range(limit):
        if a > b + eps or (abs(a - b) <= eps and abs(x) > abs(y) + eps):
            a, b, x, y = b, a, y, x
        if b > c + eps or (abs(b - c) <= eps and abs(y) > abs(z) + eps):
            b, c, y, z = c, b, z, y
            continue
        positive = sum(v > eps for v in (x, y, z))
        zero = sum(abs(v) <= eps for v in (x, y, z))
        sign = 1 if positive == 3 or (zero == 0 and positive == 1) else -1
        x, y, z = sign * abs(x), sign * abs(y), sign * abs(z)
        if abs(x) > b + eps or (abs(x - b) <= eps and 2 * y < z - eps) or (abs(x + b) <= eps and z < -eps):
            s = 1 if x > 0 else -1
            c, y, x = b + c - x * s, y - z * s, x - 2 * b * s
        elif abs(y) > a + eps or (abs(y - a) <= eps and 2 * x < z - eps) or (abs(y + a) <= eps and z < -eps):
            s = 1 if y > 0 else -1
            c, x, y = a + c - y * s, x - z * s, y - 2 * a * s
        elif abs(z) > a + eps or (abs(z - a) <= eps and 2 * x < y - eps) or (abs(z + a) <= eps and y < -eps):
            s = 1 if z > 0 else -1
            b, x, z = a + b - z * s, x - y * s, z - 2 * a * s
        elif x + y + z + a + b < -eps or (abs(x + y + z + a + b) <= eps and 2 * (a + y) + z > eps):
            c, x, y = a + b + c + x + y + z, 2 * b + x + z, 2 * a + y + z
        else:
            break
    return Cell.from_metric(np.array([[a, z / 2, y / 2], [z / 2, b, x / 2], [y / 2, x / 2, c]])), n + 1


TWO_PI = 2 * pi
