"""Operators on structures beyond atoms' rows: hydrogen bonds, links, moving windows, B factors, numbering, deuterium, names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import Vec, dist2, minus
from ..storage import small
from .alignment import superpose
from .model import table_lookup

# Covalent radii in angstroms of common elements.
COVALENT = {"H": 0.31, "D": 0.31, "C": 0.76, "N": 0.71, "O": 0.66, "F": 0.57, "NA": 1.66, "MG": 1.41, "P": 1.07, "S": 1.05, "CL": 1.02, "K": 2.03, "CA": 1.76, "MN": 1.39, "FE": 1.32, "CO": 1.26, "NI": 1.24, "CU": 1.32, "ZN": 1.22, "SE": 1.20, "BR": 1.20, "I": 1.39}


def covalent_radius(element: Column) -> Column:
    return table_lookup(F.upper(element), COVALENT, 1.5)


def _v(c: str) -> Vec:
    return F.col(f"{c}.x"), F.col(f"{c}.y"), F.col(f"{c}.z")


def with_amide_hydrogens(residues: DataFrame) -> DataFrame:
    """Adds h to backbone rows (n, ca, c, o structs): N less the direction of the previous C-O bond; null at starts and for proline."""
    w = W.partitionBy("model", "chain").orderBy("res_ord")
    r = residues.withColumn("_c", F.lag("c").over(w)).withColumn("_o", F.lag("o").over(w))
    d = minus(_v("_o"), _v("_c"))
    norm = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    h = F.struct(*((n - x / norm).alias(a) for n, x, a in zip(_v("n"), d, "xyz", strict=True)))
    return r.withColumn("h", F.when((F.col("resname") != "PRO") & F.col("_c").isNotNull() & F.col("_o").isNotNull(), h)).drop("_c", "_o")


def hydrogen_bonds(residues: DataFrame, max_ca: float = 9.0, best: int = 2) -> DataFrame:
    """Backbone hydrogen bonds by electrostatic energy (kcal/mol): donor, acceptor and the lowest two energies of each donor.

    Residues have id, ca, n, h, c, o. Pairs are found by a join on cells of CA's place.
    """
    from .spatial import neighbours

    places = residues.select("id", F.col("ca.x").alias("x"), F.col("ca.y").alias("y"), F.col("ca.z").alias("z")).where("x is not null")
    pairs = neighbours(places, places, max_ca).where("id <> id_2").select(F.col("id").alias("donor"), F.col("id_2").alias("acceptor"))
    d = residues.select(F.col("id").alias("donor"), F.col("n").alias("_n"), F.col("h").alias("_h"))
    a = residues.select(F.col("id").alias("acceptor"), F.col("c").alias("_c"), F.col("o").alias("_o"))
    j = pairs.join(d, "donor").join(a, "acceptor").where("_n is not null and _h is not null and _c is not null and _o is not null")
    r = {k: F.sqrt(dist2(_v(k[0]), _v(k[1]))) for k in (("_n", "_o"), ("_h", "_c"), ("_h", "_o"), ("_n", "_c"))}
    raw = 27.888 * (1 / r["_n", "_o"] + 1 / r["_h", "_c"] - 1 / r["_h", "_o"] - 1 / r["_n", "_c"])
    close = F.least(*r.values()) < 0.5
    e = j.withColumn("energy", F.when(close, 0.0).otherwise(F.greatest(raw, F.lit(-9.9)))).where("energy < 0")
    w = W.partitionBy("donor").orderBy("energy", "acceptor")
    return e.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= best).select("donor", "acceptor", "energy", "rank")


def possible_links(pairs: DataFrame, known: DataFrame, bond_margin: float = 1.1, radius_margin: float = 1.3) -> DataFrame:
    """Contacts that may be bonds: known links (resname, atom, resname_2, atom_2, ideal, link) within a margin, else sums of covalent radii."""
    k = small(known)
    j = pairs.join(k, ["resname", "atom", "resname_2", "atom_2"], "left")
    radii = covalent_radius(F.col("element")) + covalent_radius(F.col("element_2"))
    fits = F.when(F.col("ideal").isNotNull(), F.col("dist") <= F.col("ideal") * bond_margin).otherwise(F.col("dist") <= radii * radius_margin)
    return j.where(fits)


def moving_superposition(pairs: DataFrame, radius: float = 10.0) -> DataFrame:
    """For each matched CA of a chain: rmsd and count of the aligned run around it within radius, superposed.

    pairs: chain, ord, x, y, z, x_2, y_2, z_2 in order. A chain is one group: it is a polymer, thousands of rows at most.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord").reset_index(drop=True)
        a, b = pdf[["x", "y", "z"]].to_numpy(float), pdf[["x_2", "y_2", "z_2"]].to_numpy(float)
        rows = []
        for i in range(len(a)):
            near = ((a - a[i]) ** 2).sum(1) < radius * radius
            lo = hi = i
            while lo > 0 and near[lo - 1]:
                lo -= 1
            while hi + 1 < len(a) and near[hi + 1]:
                hi += 1
            n = hi - lo + 1
            rows.append((superpose(a[lo : hi + 1], b[lo : hi + 1])[0] if n > 2 else float("nan"), n))
        return pd.DataFrame({"chain": pdf["chain"], "ord": pdf["ord"], "rmsd": [r[0] for r in rows], "n": [r[1] for r in rows]})

    return pairs.groupBy("chain").applyInPandas(run, "chain string, ord long, rmsd double, n long")


def ranks(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """Adds average ranks (ties share the mean) within keys, for rank correlations."""
    w = W.partitionBy(*keys).orderBy(column)
    t = W.partitionBy(*keys, column)
    return df.withColumn(name, F.rank().over(w) + (F.count("*").over(t) - 1) / 2)


def b_factor_model(atoms: DataFrame, wcn: DataFrame, key: str, group: list[str]) -> DataFrame:
    """Pearson's and Spearman's correlation of B with the inverse of the weighted contact number, per group."""
    j = atoms.join(wcn, key).withColumn("_inv", 1 / F.col("wcn"))
    j = ranks(ranks(j, group, "b_iso", "_rb"), group, "_inv", "_rw")
    return j.groupBy(*group).agg(F.count("*").alias("n"), F.corr("b_iso", "_inv").alias("cc"), F.corr("_rb", "_rw").alias("rank_cc"))


def label_to_auth(residues: DataFrame, asked: DataFrame) -> DataFrame:
    """auth number of label numbers (chain, label_seq): exact, else by the offset of the nearest known residue before it."""
    known = residues.select("chain", F.col("label_seq").alias("_l"), (F.col("seqnum") - F.col("label_seq")).alias("_off"))
    both = asked.select("chain", "label_seq", F.lit(None).cast("int").alias("_off"), F.lit(1).alias("_q")).unionByName(known.select("chain", F.col("_l").alias("label_seq"), "_off", F.lit(0).alias("_q")))
    w = W.partitionBy("chain").orderBy("label_seq", "_q")
    after = W.partitionBy("chain").orderBy(F.desc("label_seq"), F.desc("_q")).rowsBetween(W.unboundedPreceding, W.currentRow)
    filled = both.withColumn("_off", F.coalesce(F.last("_off", True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)), F.last("_off", True).over(after)))
    return filled.where("_q = 1").select("chain", "label_seq", (F.col("label_seq") + F.col("_off")).alias("seqnum"))


def deuterium_as_fraction(atoms: DataFrame) -> DataFrame:
    """H and D of one place as one H row with d_fraction, its occupancy the sum."""
    place = ["model", "chain", "res_ord", F.regexp_replace("atom", "^D", "H").alias("_name")]
    h = atoms.where(F.upper("element").isin("H", "D")).withColumn("_d", F.upper("element") == "D")
    others = atoms.where(~F.upper("element").isin("H", "D")).withColumn("d_fraction", F.lit(0.0))
    rest = [c for c in atoms.columns if c not in ("model", "chain", "res_ord", "atom", "element", "occ", "altloc")]
    one = h.groupBy(*place).agg(F.sum("occ").alias("occ"), (F.sum(F.when(F.col("_d"), F.col("occ")).otherwise(0.0)) / F.sum("occ")).alias("d_fraction"), *(F.min_by(c, "atom_ord").alias(c) for c in rest))
    one = one.withColumnRenamed("_name", "atom").withColumns({"element": F.lit("H"), "altloc": F.lit("")})
    return others.unionByName(one.select(others.columns))


def deuterium_as_altlocs(atoms: DataFrame) -> DataFrame:
    """The reverse: rows of H (A) and D (D) where the fraction is between 0 and 1."""
    f = F.col("d_fraction")
    parts = F.filter(F.array(F.struct(F.lit("H").alias("e"), (1 - f).alias("w")), F.struct(F.lit("D").alias("e"), f.alias("w"))), lambda x: x["w"] > 0)
    hydrogen = F.upper("element") == "H"
    split = atoms.where(hydrogen).withColumn("_p", F.explode(parts))
    mixed = (f > 0) & (f < 1)
    split = split.withColumns({"element": F.col("_p.e"), "occ": F.col("occ") * F.col("_p.w"), "altloc": F.when(mixed, F.when(F.col("_p.e") == "D", "D").otherwise("A")).otherwise(F.col("altloc")), "atom": F.when(F.col("_p.e") == "D", F.regexp_replace("atom", "^H", "D")).otherwise(F.col("atom"))})
    return atoms.where(~hydrogen).unionByName(split.drop("_p")).drop("d_fraction")


def split_by_segment(atoms: DataFrame) -> DataFrame:
    return atoms.withColumn("chain", F.concat("chain", "segment"))


def subchains(atoms: DataFrame) -> DataFrame:
    """Adds subchain: chain with x and p for polymer, w for water, a number for every other residue."""
    other = F.dense_rank().over(W.partitionBy("model", "chain", "entity_type").orderBy("res_ord"))
    tag = F.when(F.col("entity_type") == "polymer", "p").when(F.col("entity_type") == "water", "w").otherwise(other.cast("string"))
    return atoms.withColumn("subchain", F.concat("chain", F.lit("x"), tag))


def short_names(names: DataFrame, column: str, width: int = 3) -> DataFrame:
    """Aliases of names longer than width: ~00, ~01 ... by rank."""
    from .reflections import exact_ranks

    long = names.select(column).distinct().where(F.length(column) > width)
    n = F.col("_rank").cast("string")
    return exact_ranks(long, column).select(column, F.concat(F.lit("~"), F.lpad(n, F.greatest(F.length(n), F.lit(width - 1)), F.lit("0"))).alias("alias"))


def is_rotation(r: list[Column], tolerance: float = 1e-3) -> Column:
    """Whether nine columns are a rotation: orthonormal rows and determinant 1."""
    row = [r[0:3], r[3:6], r[6:9]]
    tests = []
    for i in range(3):
        for j in range(i, 3):
            d = sum((row[i][k] * row[j][k] for k in (1, 2)), row[i][0] * row[j][0])
            tests.append(F.abs(d - (1.0 if i == j else 0.0)) < tolerance)
    det = r[0] * (r[4] * r[8] - r[5] * r[7]) - r[1] * (r[3] * r[8] - r[5] * r[6]) + r[2] * (r[3] * r[7] - r[4] * r[6])
    out = F.abs(det - 1.0) < tolerance
    for t in tests:
        out &= t
    return out


def unit_cell_sites(sites: DataFrame, group, cell, eps: float = 0.4) -> DataFrame:
    """Fractional sites of the whole cell; images of a site that fall together are one, with the mean left at the first."""
    e = sites.withColumn("_im", F.explode(group.images(F.col("fx"), F.col("fy"), F.col("fz")))).withColumn("op", F.col("_im.op"))
    e = e.withColumns({f"f{c}": F.col(f"_im.{c}") - F.floor(f"_im.{c}") for c in "xyz"}).drop("_im")
    earlier = e.select(F.col("label").alias("_l"), F.col("op").alias("_op"), *(F.col(f"f{c}").alias(f"_f{c}") for c in "xyz"))
    d = cell.orthogonalized(*((F.col(f"f{c}") - F.col(f"_f{c}")) - F.rint(F.col(f"f{c}") - F.col(f"_f{c}")) for c in "xyz"))
    same = (F.col("label") == F.col("_l")) & (F.col("_op") < F.col("op")) & (d[0] * d[0] + d[1] * d[1] + d[2] * d[2] < eps * eps)
    return e.join(earlier, same, "left_anti")


