"""Queries that have no SQL against plain numpy on the smallest tables."""

import os
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from braggframe import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
CELL = np.array([38.0, 44.0, 52.0])


def rows(spark, name):
    return catalog.queries()[name](spark, SF).toPandas()


@pytest.fixture(scope="module")
def points():
    e = pd.read_parquet(f"{SF}/embeddings.parquet")
    xyz = np.array([[float(v) * 40 for v in x[:3]] for x in e.embedding])
    return pd.DataFrame({"serial": e.vec_id, "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "label": e.label})


@pytest.fixture(scope="module")
def lineitem():
    return pd.read_parquet(f"{SF}/lineitem.parquet")


def grid_of(lineitem):
    g = defaultdict(float)
    for o, p, s, q in zip(lineitem.l_orderkey % 16, lineitem.l_partkey % 16, lineitem.l_suppkey % 16, lineitem.l_quantity, strict=True):
        g[int(o), int(p), int(s)] += q
    return g


def test_blobs(spark, lineitem):
    g = grid_of(lineitem)
    top = catalog._grid(spark, SF).approxQuantile("value", [0.9], 0.001)[0]
    left = {k for k, v in g.items() if v > top}
    found = []
    while left:
        todo, island = [left.pop()], []
        while todo:
            at = todo.pop()
            island.append(at)
            for axis in range(3):
                for step in (1, -1):
                    near = tuple((x + step * (i == axis)) % 16 for i, x in enumerate(at))
                    if near in left:
                        left.remove(near)
                        todo.append(near)
        if len(island) >= 3:
            dv = CELL.prod() / 16**3
            found.append((len(island), round(len(island) * dv, 4), round(sum(g[k] for k in island) * dv, 4), max(g[k] for k in island)))
    got = rows(spark, "grid_blobs")
    assert sorted((r.points, round(r.volume, 4), round(r.score, 4), r.peak) for r in got.itertuples()) == sorted(found)


def test_map_by_direct_sum(spark, lineitem):
    h, k, l = lineitem.l_partkey % 21 - 10, lineitem.l_suppkey % 21 - 10, lineitem.l_linenumber - 4
    mean = pd.DataFrame({"h": h, "k": k, "l": l, "f": lineitem.l_extendedprice / 1000, "phi": lineitem.l_quantity / 10 + 1}).groupby(["h", "k", "l"]).mean().reset_index()
    # Where a reflection and the mate of another meet, the first row (by its indices) and its own place win.
    best = {}
    for r in mean[mean.f != 0].itertuples():
        c = r.f * np.exp(1j * np.radians(r.phi))
        own = (r.h, r.k, r.l)
        for at, value, op in ((own, c, 0), (tuple(-x for x in own), np.conj(c), 1)):
            if at not in best or (own, op) < best[at][0]:
                best[at] = ((own, op), value)
    rng = np.random.default_rng(1)
    got = rows(spark, "fourier_map").set_index(["u", "v", "w"]).value
    index = np.array(list(best))
    values = np.array([v for _, v in best.values()])
    for u, v, w in rng.integers(0, (24, 24, 16), (40, 3)):
        phase = -2j * np.pi * (index @ np.array([u / 24, v / 24, w / 16]))
        assert got[u, v, w] == pytest.approx(float((values * np.exp(phase)).sum().real) / CELL.prod(), abs=2e-6)
    assert len(got) == 24 * 24 * 16


def test_superposition(spark, points):
    got = rows(spark, "superposed_labels").set_index("label")
    for label, p in points.dropna(subset=["label"]).groupby("label"):
        a, b = p[["x", "y", "z"]].to_numpy(), p[["y", "z", "x"]].to_numpy()
        a, b = a - a.mean(0), b - b.mean(0)
        u, s, vt = np.linalg.svd(a.T @ b)
        s[2] *= np.sign(np.linalg.det(u @ vt))
        rmsd = np.sqrt(max(0.0, (a * a).sum() + (b * b).sum() - 2 * s.sum()) / len(a))
        assert got.n[label] == len(a) and got.rmsd[label] == pytest.approx(rmsd, abs=2e-6)


def test_planes(spark, points):
    got = rows(spark, "best_planes").set_index("label")
    for label, p in points.groupby("label"):
        a = p[["x", "y", "z"]].to_numpy()
        a = a - a.mean(0)
        assert got.least[label] == pytest.approx((np.linalg.svd(a, compute_uv=False)[-1] ** 2 if len(a) > 2 else 0.0) / len(a), abs=2e-6)


def test_density(spark, points):
    size = np.array([38, 44, 52])
    rho = defaultdict(float)
    for p in points[["x", "y", "z"]].to_numpy():
        low, high = np.ceil((p - 2.5) / CELL * size).astype(int), np.floor((p + 2.5) / CELL * size).astype(int)
        for u in range(low[0], high[0] + 1):
            for v in range(low[1], high[1] + 1):
                for w in range(low[2], high[2] + 1):
                    d2 = (((np.array([u, v, w]) / size * CELL) - p) ** 2).sum()
                    if d2 <= 2.5**2:
                        rho[u % 38, v % 44, w % 52] += 6 * (4 * np.pi / 30) ** 1.5 * np.exp(-4 * np.pi**2 * d2 / 30)
    got = {(r.u, r.v, r.w): r.value for r in rows(spark, "model_density").itertuples()}
    assert set(got) == set(rho) and all(got[k] == pytest.approx(v, abs=2e-6) for k, v in rho.items())


def test_solvent(spark, points):
    size = np.array([38, 44, 52])
    at = np.stack(np.meshgrid(*(np.arange(n) for n in size), indexing="ij"), -1).reshape(-1, 3) / size
    frac = points[["x", "y", "z"]].to_numpy() / CELL

    def within(a, b, radius):
        near = np.zeros(len(a), bool)
        for f in b:
            d = a - f
            near |= (((d - np.rint(d)) * CELL) ** 2).sum(1) <= radius**2 + 1e-9
        return near

    solid = within(at, frac, 2.7)
    shell = at[~solid]
    index = np.flatnonzero(solid)
    kept = []
    for i in index:
        d = at[i] - shell
        if not ((((d - np.rint(d)) * CELL) ** 2).sum(1) <= 1.1**2 + 1e-9).any():
            kept.append(i)
    want = {tuple(x) for x in np.rint(at[kept] * size).astype(int).tolist()}
    got = {(r.u, r.v, r.w) for r in rows(spark, "solvent_mask").itertuples()}
    # A point at exactly the limit may fall to either side.
    assert len(got ^ want) <= 0.002 * len(want) + 2


def test_contacts(spark, points):
    """Every pair of an atom in the cell and an image of an atom, over the 27 cells about it."""
    f = points[["x", "y", "z"]].to_numpy() / CELL
    home = f - np.floor(f)
    images = [f, np.stack([-f[:, 0], f[:, 1] + 0.5, 0.5 - f[:, 2]], 1), np.stack([0.5 - f[:, 0], -f[:, 1], f[:, 2] + 0.5], 1), np.stack([f[:, 0] + 0.5, 0.5 - f[:, 1], -f[:, 2]], 1)]
    want, serial = 0, points.serial.to_numpy()
    for op, im in enumerate(images):
        im = im - np.floor(im)
        for shift in np.stack(np.meshgrid([-1, 0, 1], [-1, 0, 1], [-1, 0, 1]), -1).reshape(-1, 3):
            d = np.sqrt((((home[:, None] - (im + shift)[None]) * CELL) ** 2).sum(2))
            i, j = np.nonzero(d < 1.5)
            own = (i == j) & ((op == 0) | (d[i, j] < 0.8))
            want += int(((serial[i] <= serial[j]) & ~own & ~((i == j) & (op == 0))).sum())
    got = rows(spark, "crystal_contacts")
    assert len(got) == want and (got.dist < 1.5).all()


def test_alignment_scores(spark):
    """The best score by trying every cell of the table with three states, in plain Python."""
    got = rows(spark, "aligned_names")
    for r in got.itertuples():
        q, t = r.n_name, r.r_name
        neg = -(10**9)
        m = {(0, 0): 0}
        e, f = {}, {}
        for i in range(len(q) + 1):
            for j in range(len(t) + 1):
                if i:
                    f[i, j] = max(m.get((i - 1, j), neg) - 1, f.get((i - 1, j), neg)) - 1
                if j:
                    e[i, j] = max(m.get((i, j - 1), neg) - 1, e.get((i, j - 1), neg)) - 1
                if i or j:
                    diagonal = m.get((i - 1, j - 1), neg) + (1 if i and j and q[i - 1] == t[j - 1] else -1)
                    m[i, j] = max(diagonal if i and j else neg, e.get((i, j), neg), f.get((i, j), neg))
        assert r.score == m[len(q), len(t)], (q, t)


def test_eigenvalues_of_tensors(spark):
    from braggframe.operators import displacement

    rng = np.random.default_rng(2)
    made = [(lambda a: a @ a.T)(rng.normal(size=(3, 3))) for _ in range(50)] + [np.eye(3) * 0.3, np.diag([0.1, 0.1, 0.4])]
    df = spark.createDataFrame([(i, *(float(m[a]) for a in ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2)))) for i, m in enumerate(made)], ["i", *displacement.U])
    for r in displacement.principal_ratio(df).collect():
        values = np.linalg.eigvalsh(made[r.i])
        assert r.ratio == pytest.approx(values[0] / values[2], abs=1e-7) and r.b_eq == pytest.approx(8 * np.pi**2 * values.mean())


def test_elements():
    from braggframe.functions import elements

    assert len(elements.SYMBOLS) == len(set(elements.SYMBOLS)) == 118
    for symbol, number, row, group in (("H", 1, 1, 1), ("HE", 2, 1, 18), ("B", 5, 2, 13), ("AR", 18, 3, 18), ("SC", 21, 4, 3), ("ZN", 30, 4, 12), ("GA", 31, 4, 13), ("LA", 57, 6, 3), ("LU", 71, 6, 3), ("HF", 72, 6, 4), ("RN", 86, 6, 18), ("U", 92, 7, 3), ("OG", 118, 7, 18)):
        assert elements.NUMBERS[symbol] == number and (elements.row_of(number), elements.group_of(number)) == (row, group), symbol
    assert [s for s in ("LI", "C", "AL", "SI", "GE", "SN", "TE", "PO", "FE") if elements.is_metal(elements.NUMBERS[s])] == ["LI", "AL", "SN", "FE"]
