"""Lattices on the driver: reductions, symmetry of a lattice, twin laws, superlattice-free changes of basis."""

from __future__ import annotations

from itertools import product

import numpy as np

from ..functions.cell import Cell, niggli
from ..functions.symmetry import DEN, Group, Op


def selling(cell: Cell, epsilon: float = 1e-9) -> np.ndarray:
    """The six scalar products of a Delaunay-reduced base (all at most zero)."""
    o = cell.orth
    v = [o[:, 0], o[:, 1], o[:, 2], -(o[:, 0] + o[:, 1] + o[:, 2])]
    while True:
        p = {(i, j): float(v[i] @ v[j]) for i in range(4) for j in range(i + 1, 4)}
        (i, j), most = max(p.items(), key=lambda x: x[1])
        if most <= epsilon * cell.volume ** (2 / 3):
            return np.array([p[k] for k in sorted(p)])
        k, m = (x for x in range(4) if x not in (i, j))
        v[k], v[m], v[i] = v[k] + v[i], v[m] + v[i], -v[i]


def buerger(cell: Cell, limit: int = 100) -> Cell:
    """A base of three shortest vectors, by subtracting nearest multiples until no vector gets shorter."""
    v = list(cell.orth.T)
    for _ in range(limit):
        changed = False
        for i, j in product(range(3), repeat=2):
            if i != j:
                n = round(float(v[i] @ v[j]) / float(v[j] @ v[j]))
                if n and np.linalg.norm(v[i] - n * v[j]) < np.linalg.norm(v[i]) - 1e-12:
                    v[i] = v[i] - n * v[j]
                    changed = True
        if not changed:
            break
    v.sort(key=lambda x: float(x @ x))
    return Cell.from_metric(np.array(v) @ np.array(v).T)


def twofold_axes(cell: Cell, max_obliquity: float = 3.0) -> list[tuple[Op, float]]:
    """Two-fold axes of a reduced cell's lattice with their obliquity in degrees, the least oblique first.

    An axis is a lattice row and the plane normal to it: integer triples up to 2 with a product of 1 or 2.
    """
    out: dict[Op, float] = {}
    triples = [t for t in product(range(-2, 3), repeat=3) if t > (0, 0, 0) and np.gcd.reduce(t) == 1]
    direct, recip = cell.orth, np.linalg.inv(cell.orth).T
    for u in triples:
        d = direct @ np.array(u)
        for h in [np.array(t) for t in product(range(-2, 3), repeat=3)]:
            dot = int(h @ np.array(u))
            if dot not in (1, 2) or not h.any() or np.gcd.reduce(h) != 1:
                continue
            r = recip @ h
            delta = float(np.degrees(np.arctan2(np.linalg.norm(np.cross(d, r)), abs(d @ r))))
            m = 2 * np.outer(u, h) - dot * np.eye(3, dtype=int)
            if delta <= max_obliquity and not (m % dot).any():
                op = Op(tuple(tuple(int(x) * DEN for x in row) for row in m // dot))
                out[op] = min(delta, out.get(op, 1e9))
    return sorted(out.items(), key=lambda x: x[1])


def lattice_symmetry(cell: Cell, centring: str = "P", max_obliquity: float = 3.0) -> Group:
    """The group that the two-fold axes generate (those that keep it finite, the least oblique first), for a primitive cell."""
    if centring != "P":
        raise ValueError("give the primitive cell")
    reduced, _ = niggli(cell)
    generators: list[Op] = []
    group = Group([])
    for op, _ in twofold_axes(reduced, max_obliquity):
        try:
            bigger = Group([*generators, op])
        except ValueError:
            continue
        if len(bigger.ops) > 24:
            continue
        generators.append(op)
        group = bigger
    return group


def twin_laws(cell: Cell, group: Group, max_obliquity: float = 3.0) -> list[Op]:
    """One operation of each coset of the lattice's rotations that the point group lacks."""
    lattice = lattice_symmetry(cell, "P", max_obliquity)
    own = {o.rot for o in group.sym_ops} | {tuple(tuple(-x for x in r) for r in o.rot) for o in group.sym_ops}
    seen, out = set(own), []
    for o in lattice.sym_ops:
        if o.rot not in seen:
            out.append(Op(o.rot))
            for p in own:
                seen.add(tuple(tuple(int(x) for x in r) for r in (np.array(o.rot) @ np.array(p) // DEN)))
    return out


def changed_basis(cell: Cell, op: Op) -> Cell:
    """The cell of the base vectors' new combinations: columns of the inverse of op's rotation."""
    m = np.linalg.inv(np.array(op.rot) / DEN)
    return Cell.from_metric(m.T @ cell.metric @ m)


def compatible(cell: Cell, group: Group, tolerance: float = 1e-3) -> bool:
    """Whether every operation leaves the metric tensor alone."""
    g = cell.metric
    return all(np.allclose((np.array(o.rot) / DEN).T @ g @ (np.array(o.rot) / DEN), g, atol=tolerance * np.abs(g).max()) for o in group.sym_ops)


def average_cell(cells):
    """Mean and deviation of cell parameters over rows (a, b, c, alpha, beta, gamma), as from batch headers."""
    from pyspark.sql import functions as F

    names = ["a", "b", "c", "alpha", "beta", "gamma"]
    return cells.agg(*(F.avg(n).alias(n) for n in names), *(F.stddev_pop(n).alias(f"rms_{n}") for n in names))
