"""Density grids as rows (u, v, w, value): symmetry, interpolation, islands, Fourier synthesis, densities of atoms."""

from __future__ import annotations

from math import pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cell import Cell
from ..functions.symmetry import DEN, Group
from ..storage import stored

UVW = ["u", "v", "w"]


def grid_images(group: Group, size: tuple[int, int, int]) -> Column:
    """Array of the grid points that the operations send (u, v, w) to; sizes must suit the group."""
    rows = []
    for o in group.ops:
        new = []
        for i in range(3):
            terms = [F.col(c) * int(o.rot[i][j] * size[i] // (DEN * size[j])) for j, c in enumerate(UVW) if o.rot[i][j]]
            shift = o.tran[i] * size[i] // DEN
            new.append(F.pmod(sum(terms[1:], terms[0]) + shift, F.lit(size[i])).cast("int"))
        rows.append(F.struct(*(x.alias(c) for x, c in zip(new, UVW, strict=True))))
    return F.array(*rows)


def symmetrized(grid: DataFrame, group: Group, size: tuple[int, int, int], how: str = "max") -> DataFrame:
    """Every point gets the min, max, sum, avg or absmax of its orbit; points keyed by the orbit's least member."""
    keyed = grid.withColumn("_orbit", F.array_min(grid_images(group, size)))
    v = F.col("value")
    agg = {"min": F.min(v), "max": F.max(v), "sum": F.sum(v) * F.lit(len(group.ops)) / F.count(v), "avg": F.avg(v), "absmax": F.max_by(v, F.abs(v))}[how]
    return keyed.select(*UVW, "_orbit").join(keyed.groupBy("_orbit").agg(agg.alias("value")), "_orbit").drop("_orbit")


def interpolated(points: DataFrame, grid: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    """Adds value: trilinear interpolation at fractional fx, fy, fz, over the eight grid points around, across the cell's edges."""
    p = points.withColumn("_id", F.monotonically_increasing_id())
    for f, c, n in zip(("fx", "fy", "fz"), UVW, size, strict=True):
        at = F.col(f) * n
        p = p.withColumn(f"_{c}", F.floor(at).cast("int")).withColumn(f"_d{c}", at - F.floor(at))
    corners = F.array(*(F.struct(*(F.lit(int(b)).alias(c) for c, b in zip(UVW, f"{i:03b}", strict=True))) for i in range(8)))
    e = p.withColumn("_k", F.explode(corners))
    weight = F.lit(1.0)
    for c, n in zip(UVW, size, strict=True):
        e = e.withColumn(c, F.pmod(F.col(f"_{c}") + F.col(f"_k.{c}"), F.lit(n)).cast("int"))
        weight = weight * F.when(F.col(f"_k.{c}") == 1, F.col(f"_d{c}")).otherwise(1 - F.col(f"_d{c}"))
    j = e.withColumn("_weight", weight).join(grid.select(*UVW, F.col("value").alias("_value")), UVW)
    return j.groupBy(*points.columns, "_id").agg(F.sum(F.col("_weight") * F.col("_value")).alias("value")).drop("_id")


def normalized(grid: DataFrame) -> DataFrame:
    s = grid.agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    return grid.crossJoin(F.broadcast(s)).withColumn("value", F.when(F.col("_s") != 0, (F.col("value") - F.col("_m")) / F.col("_s")).otherwise(0.0)).drop("_m", "_s")


def islands(grid: DataFrame, cutoff: float, size: tuple[int, int, int], keys: list[str] = ()) -> DataFrame:
    """Points above the cutoff with the island they belong to (its least point), six neighbours across the cell's edges.

    Labels spread by a join with the neighbours until none changes; each round is written to the shared folder.
    """
    lit = grid.where(F.col("value") > cutoff)
    code = (F.col("u").cast("long") * size[1] + F.col("v")) * size[2] + F.col("w")
    nodes = lit.withColumn("_id", code)
    steps = F.array(*(F.struct(*(F.lit(x).alias(c) for x, c in zip(s, UVW, strict=True))) for s in ((1, 0, 0), (0, 1, 0), (0, 0, 1))))
    e = nodes.select(*UVW, "_id", F.explode(steps).alias("s"))
    to = (F.pmod(F.col("u") + F.col("s.u"), F.lit(size[0])).cast("long") * size[1] + F.pmod(F.col("v") + F.col("s.v"), F.lit(size[1]))) * size[2] + F.pmod(F.col("w") + F.col("s.w"), F.lit(size[2]))
    edges = e.select(F.col("_id").alias("a"), to.alias("b")).join(nodes.select(F.col("_id").alias("b")), "b", "left_semi").where("a <> b")
    found = graph_components(edges)
    return nodes.join(found.withColumnRenamed("node", "_id"), "_id", "left").withColumn("island", F.coalesce("component", "_id")).drop("_id", "component")


def graph_components(edges: DataFrame) -> DataFrame:
    """(node, component): least labels spread over edges and are followed to their own label, so rounds grow with the logarithm of a path.

    Every round is a table in the shared folder, which cuts its lineage.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    label = both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    last = None
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        low = label.join(near, label["node"] == near["a"], "left").select("node", F.least("component", F.coalesce("near", "component")).alias("component"))
        far = low.select(F.col("node").alias("component"), F.col("component").alias("far"))
        label = stored(low.join(far, "component", "left").select("node", F.least("component", F.coalesce("far", "component")).alias("component")), "labels")
        total = label.agg(F.sum(F.col("component").cast("decimal(38,0)")), F.count("*")).first()
        if total == last:
            return label
        last = total


def blobs(grid: DataFrame, cutoff: float, cell: Cell, size: tuple[int, int, int], min_points: int = 3) -> DataFrame:
    """Islands with volume, score (sum of values times the volume of a point), peak and its point, by falling score."""
    dv = cell.volume / (size[0] * size[1] * size[2])
    i = islands(grid, cutoff, size)
    out = i.groupBy("island").agg(F.count("*").alias("points"), (F.count("*") * dv).alias("volume"), (F.sum("value") * dv).alias("score"), F.max("value").alias("peak"), F.max_by(F.struct(*UVW), "value").alias("peak_at"))
    return out.where(F.col("points") >= min_points).orderBy(F.desc("score"))


def subarray(grid: DataFrame, start: tuple[int, int, int], shape: tuple[int, int, int], size: tuple[int, int, int]) -> DataFrame:
    """Points of a box that may lie across the cell's edges, with i, j, k from its corner."""
    out = grid
    for c, name, s, n, m in zip(UVW, "ijk", start, shape, size, strict=True):
        out = out.withColumn(name, F.pmod(F.col(c) - s, F.lit(m)).cast("int")).where(F.col(name) < n)
    return out


def reciprocal_points(df: DataFrame, group: Group, f: str, phi: str) -> DataFrame:
    """Complex coefficients (h, k, l, re, im) of all equivalents and Friedel mates; where two meet, the first row and operation win."""
    e = df.where(F.col(f) != 0).withColumn("_row", F.struct("h", "k", "l")).withColumn("_e", F.explode(group.equivalents(F.col("h"), F.col("k"), F.col("l"))))
    ang = F.radians(F.col(phi) + F.col("_e.shift"))
    a = e.select("_row", "_e.op", "_e.h", "_e.k", "_e.l", (F.col(f) * F.cos(ang)).alias("re"), (F.col(f) * F.sin(ang)).alias("im"))
    mates = a.select("_row", (F.col("op") + 1000).alias("op"), (-F.col("h")).alias("h"), (-F.col("k")).alias("k"), (-F.col("l")).alias("l"), "re", (-F.col("im")).alias("im"))
    return a.unionByName(mates).groupBy("h", "k", "l").agg(F.min_by(F.struct("re", "im"), F.struct("_row", "op")).alias("c")).select("h", "k", "l", "c.re", "c.im")


def map_from_coefficients(coefficients: DataFrame, keys: list[str], size: tuple[int, int, int], volume: float) -> DataFrame:
    """A grid for each of keys by a Fourier synthesis of its (h, k, l, re, im). A map is one task: the transform needs it whole."""

    def synthesis(pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.zeros(size, complex)
        np.add.at(g, tuple(np.mod(pdf[c].to_numpy(), n) for c, n in zip("hkl", size, strict=True)), pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy())
        rho = np.fft.fftn(g).real / volume
        u, v, w = (x.ravel() for x in np.indices(size))
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "u": u.astype("int32"), "v": v.astype("int32"), "w": w.astype("int32"), "value": rho.ravel()})

    types = ", ".join(f"`{k}` {dict(coefficients.dtypes)[k]}" for k in keys)
    return coefficients.groupBy(*keys).applyInPandas(synthesis, f"{types}{', ' if keys else ''}u int, v int, w int, value double")


def coefficients_from_map(grid: DataFrame, keys: list[str], size: tuple[int, int, int], volume: float) -> DataFrame:
    """(h, k, l, f, phi) of a half-space from a grid of each of keys."""

    def analysis(pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.zeros(size)
        g[tuple(pdf[c].to_numpy() for c in UVW)] = pdf["value"].to_numpy()
        c = np.conj(np.fft.fftn(g)) * volume / g.size
        h, k, l = np.meshgrid(*(np.where(np.arange(n) <= (n - 1) // 2, np.arange(n), np.arange(n) - n) for n in size), indexing="ij")
        keep = (l > 0) | ((l == 0) & ((h > 0) | ((h == 0) & (k >= 0))))
        return pd.DataFrame({**{x: pdf[x].iloc[0] for x in keys}, "h": h[keep].astype("int32"), "k": k[keep].astype("int32"), "l": l[keep].astype("int32"), "f": np.abs(c[keep]), "phi": np.degrees(np.angle(c[keep])) % 360})

    types = ", ".join(f"`{k}` {dict(grid.dtypes)[k]}" for k in keys)
    return grid.groupBy(*keys).applyInPandas(analysis, f"{types}{', ' if keys else ''}h int, k int, l int, f double, phi double")


def structure_factors(hkl: DataFrame, atoms: DataFrame, cell: Cell, group: Group) -> DataFrame:
    """Direct summation: (h, k, l, re, im) from atoms with fx, fy, fz, occ, b_iso and Gaussian form factors a, b (arrays) and c.

    Every reflection meets every atom: the sum is over all of them. The atoms' side is broadcast when small.
    """
    a = atoms.withColumn("_im", F.explode(group.images(F.col("fx"), F.col("fy"), F.col("fz"))))
    side = F.broadcast(a) if atoms.count() * len(group.ops) <= 200_000 else a
    j = hkl.crossJoin(side).withColumn("_s", cell.stol2(F.col("h"), F.col("k"), F.col("l")))
    form = F.aggregate(F.arrays_zip("a", "b"), F.lit(0.0), lambda t, x: t + x["a"] * F.exp(-x["b"] * F.col("_s"))) + F.col("c")
    arg = 2 * pi * (F.col("h") * F.col("_im.x") + F.col("k") * F.col("_im.y") + F.col("l") * F.col("_im.z"))
    amp = F.col("occ") * form * F.exp(-F.col("b_iso") * F.col("_s"))
    return j.groupBy("h", "k", "l").agg(F.sum(amp * F.cos(arg)).alias("re"), F.sum(amp * F.sin(arg)).alias("im"))


def near_points(atoms: DataFrame, cell: Cell, size: tuple[int, int, int], radius: Column | float, max_radius: float) -> DataFrame:
    """Grid points within a radius of each atom: an explosion of a stencil of max_radius, held to the exact distance; adds u, v, w, dist."""
    reach = [int(np.ceil(max_radius * np.linalg.norm(cell.frac[i]) * size[i])) for i in range(3)]
    f = cell.fractional(F.col("x"), F.col("y"), F.col("z"))
    out = atoms.withColumns({f"_f{c}": v for c, v in zip(UVW, f, strict=True)})
    for c, n, r in zip(UVW, size, reach, strict=True):
        out = out.withColumn(f"_{c}", F.explode(F.sequence(F.lit(-r), F.lit(r)))).withColumn(f"_{c}", F.floor(F.col(f"_f{c}") * n) + F.col(f"_{c}"))
    d = cell.orthogonalized(*(F.col(f"_{c}") / n - F.col(f"_f{c}") for c, n in zip(UVW, size, strict=True)))
    out = out.withColumn("dist", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])).where(F.col("dist") <= radius)
    return out.withColumns({c: F.pmod(F.col(f"_{c}"), F.lit(n)).cast("int") for c, n in zip(UVW, size, strict=True)}).drop(*(f"_{c}" for c in UVW), *(f"_f{c}" for c in UVW))


def model_density(atoms: DataFrame, cell: Cell, size: tuple[int, int, int], cutoff: float = 3.0) -> DataFrame:
    """Density of Gaussian atoms (weight z, spread from b_iso) on the points within the cutoff; others are absent, zero."""
    p = near_points(atoms, cell, size, cutoff, cutoff)
    b = F.greatest(F.col("b_iso"), F.lit(5.0)) + 10.0
    rho = F.col("occ") * F.col("z_number") * F.pow(4 * pi / b, 1.5) * F.exp(-4 * pi * pi * F.col("dist") * F.col("dist") / b)
    return p.groupBy(*UVW).agg(F.sum(rho).alias("value"))


def solvent_mask(atoms: DataFrame, cell: Cell, size: tuple[int, int, int], probe: float = 1.0, shrink: float = 1.1, max_radius: float = 3.5) -> DataFrame:
    """Points (u, v, w) that are not solvent: within an atom's radius and the probe, less those within shrink of the solvent."""
    spark = atoms.sparkSession
    solid = near_points(atoms, cell, size, F.col("radius") + probe, max_radius + probe).select(*UVW).distinct()
    axis = lambda n, c: spark.range(n).select(F.col("id").cast("int").alias(c))
    every = axis(size[0], "u").crossJoin(F.broadcast(axis(size[1], "v"))).crossJoin(F.broadcast(axis(size[2], "w")))
    solvent = every.join(solid, UVW, "left_anti")
    pos = cell.orthogonalized(*(F.col(c) / float(n) for c, n in zip(UVW, size, strict=True)))
    at = solvent.select(*(x.alias(c) for x, c in zip(pos, "xyz", strict=True)))
    eaten = near_points(at, cell, size, shrink, shrink).select(*UVW).distinct()
    return solid.join(eaten, UVW, "left_anti")




def tricubic(points: DataFrame, grid: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    """Adds value: tricubic (Catmull-Rom) interpolation at fractional fx, fy, fz over the 64 grid points around."""
    p = points.withColumn("_id", F.monotonically_increasing_id())
    for f, c, n in zip(("fx", "fy", "fz"), UVW, size, strict=True):
        at = F.col(f) * n
        p = p.withColumn(f"_{c}", F.floor(at).cast("int")).withColumn(f"_t{c}", at - F.floor(at))
    offsets = F.array(*(F.struct(*(F.lit(x).alias(c) for c, x in zip(UVW, (i - 1, j - 1, k - 1), strict=True))) for i in range(4) for j in range(4) for k in range(4)))
    e = p.withColumn("_k", F.explode(offsets))
    weight = F.lit(1.0)
    for c, n in zip(UVW, size, strict=True):
        e = e.withColumn(c, F.pmod(F.col(f"_{c}") + F.col(f"_k.{c}"), F.lit(n)).cast("int"))
        t, o = F.col(f"_t{c}"), F.col(f"_k.{c}")
        one = F.when(o == -1, ((-t + 2) * t - 1) * t / 2).when(o == 0, ((3 * t - 5) * t * t + 2) / 2).when(o == 1, ((-3 * t + 4) * t + 1) * t / 2).otherwise((t - 1) * t * t / 2)
        weight = weight * one
    j = e.withColumn("_weight", weight).join(grid.select(*UVW, F.col("value").alias("_value")), UVW)
    return j.groupBy(*points.columns, "_id").agg(F.sum(F.col("_weight") * F.col("_value")).alias("value")).drop("_id")


def nearest_values(points: DataFrame, grid: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    """Adds value of the nearest grid point, null where there is none."""
    p = points.withColumns({c: F.pmod(F.floor(F.col(f) * n + 0.5), F.lit(n)).cast("int") for f, c, n in zip(("fx", "fy", "fz"), UVW, size, strict=True)})
    return p.join(grid.select(*UVW, "value"), UVW, "left").drop(*UVW)


def resampled(grid: DataFrame, size: tuple[int, int, int], new_size: tuple[int, int, int]) -> DataFrame:
    """The grid of the same cell at another size, by trilinear interpolation."""
    spark = grid.sparkSession
    axis = lambda n, c: spark.range(n).select(F.col("id").cast("int").alias(c))
    every = axis(new_size[0], "u").crossJoin(F.broadcast(axis(new_size[1], "v"))).crossJoin(F.broadcast(axis(new_size[2], "w")))
    p = every.select(F.col("u").alias("_nu"), F.col("v").alias("_nv"), F.col("w").alias("_nw"), *((F.col(c) / n).alias(f) for c, n, f in zip(UVW, new_size, ("fx", "fy", "fz"), strict=True)))
    return interpolated(p, grid, size).select(F.col("_nu").alias("u"), F.col("_nv").alias("v"), F.col("_nw").alias("w"), "value")


def grid_correlation(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: correlation, slope and count over the common points of two grids."""
    j = a.select(*UVW, F.col("value").alias("_a")).join(b.select(*UVW, F.col("value").alias("_b")), UVW)
    return j.agg(F.corr("_a", "_b").alias("cc"), F.regr_slope("_b", "_a").alias("slope"), F.count("*").alias("n"))


def soft_edge(mask: DataFrame, cell: Cell, size: tuple[int, int, int], width: float) -> DataFrame:
    """A mask (points of value 1 only) with a cosine edge: other points within width fall from 1 to 0 by their distance to it."""
    pos = cell.orthogonalized(*(F.col(c) / float(n) for c, n in zip(UVW, size, strict=True)))
    at = mask.where("value >= 1").select(*(x.alias(c) for x, c in zip(pos, "xyz", strict=True)))
    near = near_points(at, cell, size, width, width).groupBy(*UVW).agg(F.min("dist").alias("_d"))
    return near.select(*UVW, (0.5 * (1 + F.cos(pi * F.col("_d") / width))).alias("value"))


# A cube as six tetrahedra around the diagonal from corner 0 to corner 7; corner bits are u, v, w.
_TETRAHEDRA = [(0, 1, 3, 7), (0, 3, 2, 7), (0, 2, 6, 7), (0, 6, 4, 7), (0, 4, 5, 7), (0, 5, 1, 7)]


def isosurface(grid: DataFrame, level: float, size: tuple[int, int, int], keys: list[str] = ()) -> DataFrame:
    """Triangles (p1, p2, p3 of fractional x, y, z) of the surface at a level, by marching tetrahedra over the periodic cell.

    Cubes are gathered by an equi-join of a point with its eight corners; each is solved by itself.
    """
    corner = F.array(*(F.struct(*(F.lit((i >> b) & 1).alias(c) for b, c in enumerate(UVW)), F.lit(i).alias("i")) for i in range(8)))
    e = grid.withColumn("_k", F.explode(corner))
    base = [F.pmod(F.col(c) - F.col(f"_k.{c}"), F.lit(n)).cast("int").alias(c) for c, n in zip(UVW, size, strict=True)]
    cubes = e.select(*keys, *base, F.struct(F.col("_k.i").alias("i"), F.col("value").alias("value")).alias("c")).groupBy(*keys, *UVW).agg(F.sort_array(F.collect_list("c")).alias("c"), F.min("c.value").alias("lo"), F.max("c.value").alias("hi"))  # eight rows a cube
    crossed = cubes.where((F.col("lo") < level) & (F.col("hi") >= level) & (F.size("c") == 8)).drop("lo", "hi")

    def run(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                values = [c["value"] for c in r.c]
                origin = (r.u, r.v, r.w)
                place = [tuple((origin[b] + ((i >> b) & 1)) / size[b] for b in range(3)) for i in range(8)]
                for tet in _TETRAHEDRA:
                    inside = [i for i in tet if values[i] >= level]
                    outside = [i for i in tet if values[i] < level]
                    cut = lambda a, b, values=values, place=place: [x + (y - x) * (level - values[a]) / (values[b] - values[a]) for x, y in zip(place[a], place[b], strict=True)]
                    if len(inside) == 1 or len(outside) == 1:
                        one, three = (inside[0], outside) if len(inside) == 1 else (outside[0], inside)
                        triangles = [[cut(one, b) for b in three]]
                    elif len(inside) == 2:
                        (a, b), (c, d) = inside, outside
                        q = [cut(a, c), cut(a, d), cut(b, d), cut(b, c)]
                        triangles = [[q[0], q[1], q[2]], [q[0], q[2], q[3]]]
                    else:
                        triangles = []
                    rows += [tuple(getattr(r, k) for k in keys) + tuple(t) for t in triangles]
            yield pd.DataFrame(rows, columns=[*keys, "p1", "p2", "p3"])

    types = ", ".join(f"`{k}` {dict(grid.dtypes)[k]}" for k in keys)
    return crossed.mapInPandas(run, f"{types}{', ' if keys else ''}p1 array<double>, p2 array<double>, p3 array<double>")
