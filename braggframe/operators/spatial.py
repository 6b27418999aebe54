"""Joins in space: neighbours within a radius, contacts, nearest images, copies by symmetry.

The join is an equi-join on cells of the radius' size: probes look up their 27 cells, positions one; what meets is held
to the exact distance. With a unit cell, positions are first copied by the group's operations, moved into the cell and
given the shift of each side that a probe's cell may lie across.
"""

from __future__ import annotations

from itertools import product
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cell import Cell
from ..functions.symmetry import Group


def _bucket(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def neighbours(a: DataFrame, b: DataFrame, radius: float, min_dist: float = 0.0, on: tuple[str, ...] = (), xyz: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """Pairs closer than radius (and at least min_dist) in plain space, equal in the columns on; columns of b get _2, and dist.

    A dense cell is a hot key of the join: its size is bounded by what a radius can hold of real atoms, and a skewed
    join splits it.
    """
    left = a.withColumns({f"_{c}": _bucket(F.col(c), radius) for c in xyz})
    steps = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(s, "ijk", strict=True))) for s in product((-1, 0, 1), repeat=3)))
    right = b.select(*(F.col(c).alias(c if c in on else f"{c}_2") for c in b.columns))
    near = left.withColumn("_s", F.explode(steps))
    for c, n in zip(xyz, "ijk", strict=True):
        near = near.withColumn(f"_{c}", F.col(f"_{c}") + F.col(f"_s.{n}"))
    right = right.withColumns({f"_{c}": _bucket(F.col(f"{c}_2"), radius) for c in xyz})
    d2 = sum(((F.col(c) - F.col(f"{c}_2")) * (F.col(c) - F.col(f"{c}_2")) for c in xyz[1:]), (F.col(xyz[0]) - F.col(f"{xyz[0]}_2")) * (F.col(xyz[0]) - F.col(f"{xyz[0]}_2")))
    joined = near.drop("_s").join(right, [*on, *(f"_{c}" for c in xyz)]).withColumn("_d2", d2)
    kept = joined.where((F.col("_d2") < radius * radius) & (F.col("_d2") >= min_dist * min_dist))
    return kept.withColumn("dist", F.sqrt("_d2")).drop("_d2", *(f"_{c}" for c in xyz))


def compatible(a: Column, b: Column) -> Column:
    """Whether two alternative locations can stand together; none goes with any."""
    empty = lambda x: x.isNull() | (x == "")
    return empty(a) | empty(b) | (a == b)


def crystal_images(atoms: DataFrame, cell: Cell, group: Group, radius: float) -> DataFrame:
    """Atoms and their copies by every operation, in the unit cell and in what lies within radius of it: adds image (operation), fx, fy, fz, and x, y, z of the copy."""
    fx, fy, fz = cell.fractional(F.col("x"), F.col("y"), F.col("z"))
    rows = atoms.withColumn("_im", F.explode(group.images(fx, fy, fz))).withColumn("image", F.col("_im.op"))
    margin = [radius * float((cell.frac[i] ** 2).sum() ** 0.5) for i in range(3)]
    for i, c in enumerate("xyz"):
        inside = F.col(f"_im.{c}") - F.floor(f"_im.{c}")
        reach = ceil(margin[i])
        rows = rows.withColumn(f"f{c}", inside)
        options = F.array(*(F.lit(float(n)) for n in range(-reach, reach + 1)))
        rows = rows.withColumn(f"_n{c}", F.explode(_shifts(options, f"f{c}", margin[i])))
        rows = rows.withColumn(f"f{c}", F.col(f"f{c}") + F.col(f"_n{c}")).drop(f"_n{c}")
    x, y, z = cell.orthogonalized(F.col("fx"), F.col("fy"), F.col("fz"))
    return rows.drop("_im").withColumns({"x": x, "y": y, "z": z})


def _shifts(options: Column, name: str, margin: float) -> Column:
    return F.filter(options, lambda n: (F.col(name) + n >= -margin) & (F.col(name) + n <= 1 + margin))


def in_cell(atoms: DataFrame, cell: Cell) -> DataFrame:
    """Atoms moved by whole cells into the unit cell."""
    f = cell.fractional(F.col("x"), F.col("y"), F.col("z"))
    moved = cell.orthogonalized(*(v - F.floor(v) for v in f))
    return atoms.withColumns(dict(zip("xyz", moved, strict=True)))


def crystal_neighbours(atoms: DataFrame, cell: Cell, group: Group, radius: float, atom_id: str = "serial", min_dist: float = 0.0) -> DataFrame:
    """Pairs of an atom and an image of an atom closer than radius; the atom itself unmoved is left out, its images are not."""
    a = in_cell(atoms, cell)
    b = crystal_images(atoms, cell, group, radius)
    pairs = neighbours(a, b, radius, min_dist)
    same = (F.col(atom_id) == F.col(f"{atom_id}_2")) & (F.col("dist") < 1e-6)
    return pairs.where(~same)


def contacts(pairs: DataFrame, ignore: str = "residue", min_occ: float = 0.0, special_cutoff: float = 0.8, radii: Column | None = None) -> DataFrame:
    """Neighbour pairs that are contacts, each once. ignore: nothing, residue, adjacent, chain or asu.

    Rows have chain, res_ord, atom_ord, altloc, occ and the same with _2, image_2 and dist. Coincident images of an atom
    are special positions, not contacts.
    """
    one = F.struct("chain", "res_ord", "atom_ord")
    two = F.struct(F.col("chain_2").alias("chain"), F.col("res_ord_2").alias("res_ord"), F.col("atom_ord_2").alias("atom_ord"))
    image = F.coalesce(F.col("image_2"), F.lit(0)) if "image_2" in pairs.columns else F.lit(0)
    same_chain = (F.col("chain") == F.col("chain_2")) & (image == 0)
    skip = {"nothing": F.lit(False), "residue": same_chain & (F.col("res_ord") == F.col("res_ord_2")), "adjacent": same_chain & (F.abs(F.col("res_ord") - F.col("res_ord_2")) <= 1), "chain": same_chain, "asu": image == 0}[ignore]
    keep = ~skip & (one <= two) & compatible(F.col("altloc"), F.col("altloc_2")) & (F.col("occ") >= min_occ) & (F.col("occ_2") >= min_occ)
    keep &= ~((one == two) & (F.col("dist") < special_cutoff))
    keep &= ~((one == two) & (image == 0))
    if radii is not None:
        keep &= F.col("dist") < radii
    return pairs.where(keep)


def nearest(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The nearest partner of each key."""
    rest = [c for c in pairs.columns if c not in keys]
    return pairs.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("dist", *[c for c in rest if c != "dist"][:1])).alias("_n")).select(*keys, "_n.*")


def contact_number(pairs: DataFrame, key: str, power: float = 2.0, occ: str = "occ_2") -> DataFrame:
    """Weighted contact number: the sum of occupancy over distance to the power."""
    return pairs.where("dist > 0").groupBy(key).agg(F.sum(F.col(occ) / F.pow("dist", power)).alias("wcn"))


def nearest_image(df: DataFrame, cell: Cell, group: Group, a: tuple[str, str, str], b: tuple[str, str, str], asu: str = "any") -> DataFrame:
    """For each row the shortest distance from a to an image of b (fractional), with the operation: dist, op.

    Cell shifts follow by rounding the fractional difference. asu same: no images; different: the unmoved identity is left out.
    """
    images = group.images(*(F.col(c) for c in b))

    def measured(im: Column) -> Column:
        d = [im[c] - F.col(v) for c, v in zip("xyz", a, strict=True)]
        d = d if asu == "same" else [v - F.rint(v) for v in d]
        x, y, z = cell.orthogonalized(*d)
        return F.struct((x * x + y * y + z * z).alias("d2"), im["op"].alias("op"))

    options = F.transform(images, measured)
    if asu == "same":
        options = F.slice(options, 1, 1)
    if asu == "different":
        options = F.slice(options, 2, len(group.ops))
    return df.withColumn("_n", F.array_min(options)).withColumns({"dist": F.sqrt("_n.d2"), "op": F.col("_n.op")}).drop("_n")


def copied_by(atoms: DataFrame, operations: DataFrame, on: str = "chain") -> DataFrame:
    """Assembly or NCS copies: operations has the column on, op_name, r11 ... r33, t1, t2, t3. Chains get the operation's name."""
    j = atoms.join(operations, on)
    new = [F.col(f"r{i}1") * F.col("x") + F.col(f"r{i}2") * F.col("y") + F.col(f"r{i}3") * F.col("z") + F.col(f"t{i}") for i in (1, 2, 3)]
    drop = [f"r{i}{k}" for i in (1, 2, 3) for k in (1, 2, 3)] + ["t1", "t2", "t3"]
    return j.withColumns(dict(zip("xyz", new, strict=True))).withColumn("chain", F.concat("chain", "op_name")).drop(*drop)


def merged_copies(atoms: DataFrame, max_dist: float = 0.2) -> DataFrame:
    """Averages atoms of one name, element, altloc, residue and B in different chains closer than max_dist; occupancy is at most 1."""
    keys = ("atom", "element", "altloc", "resname", "seqnum", "b_iso")
    pairs = neighbours(atoms, atoms, max_dist, on=keys).where("chain <> chain_2")
    groups = pairs.groupBy(*atoms.columns).agg(F.min(F.least("chain", "chain_2")).alias("_to"), F.avg("x_2").alias("_x"), F.avg("y_2").alias("_y"), F.avg("z_2").alias("_z"), F.count("*").alias("_n"))
    n = F.col("_n")
    mean = lambda c: (F.col(c) + F.col(f"_{c}") * n) / (n + 1)
    some = groups.where("chain = _to").withColumns({c: mean(c) for c in "xyz"} | {"occ": F.least(F.lit(1.0), F.col("occ") * (n + 1))}).select(*atoms.columns)
    alone = atoms.join(pairs.select(*atoms.columns).distinct(), atoms.columns, "left_anti")
    return alone.unionByName(some)
