"""Atom tables: conformers, residues in sequence, torsions, masses, edits, entities.

Order columns (atom_ord, res_ord) carry the order of the file; every adjacent-row rule is a window over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import Vec, dihedral, dist2
from ..storage import small

RESIDUE = ["model", "chain", "res_ord"]
# Standard weights of the elements that biology uses most; others come with a table of their own.
WEIGHTS = {"H": 1.00794, "D": 2.0141, "C": 12.0107, "N": 14.0067, "O": 15.9994, "F": 18.998403, "NA": 22.98977, "MG": 24.305, "P": 30.973762, "S": 32.065, "CL": 35.453, "K": 39.0983, "CA": 40.078, "MN": 54.938045, "FE": 55.845, "CO": 58.933195, "NI": 58.6934, "CU": 63.546, "ZN": 65.38, "SE": 78.96, "BR": 79.904, "I": 126.90447}
# Three- and one-letter codes and residue weights less nothing (free amino acids).
AMINO = {"ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V", "MSE": "M", "SEC": "U", "PYL": "O"}
AMINO_WEIGHTS = {"ALA": 89.093, "ARG": 175.209, "ASN": 132.118, "ASP": 133.103, "CYS": 121.158, "GLN": 146.144, "GLU": 147.129, "GLY": 75.067, "HIS": 156.162, "ILE": 131.173, "LEU": 131.173, "LYS": 147.195, "MET": 149.211, "PHE": 165.189, "PRO": 115.130, "SER": 105.093, "THR": 119.119, "TRP": 204.225, "TYR": 181.189, "VAL": 117.146}


def table_lookup(key: Column, table: dict, default=None) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key), F.lit(default))


def first_conformer(atoms: DataFrame) -> DataFrame:
    """The first row of each atom name in a residue."""
    w = W.partitionBy(*RESIDUE, "atom").orderBy("atom_ord")
    return atoms.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def without_hydrogens(atoms: DataFrame) -> DataFrame:
    return atoms.where(~F.upper("element").isin("H", "D", "T"))


def trimmed_to_alanine(atoms: DataFrame) -> DataFrame:
    """Where a residue has a CA, only its N, CA, C, O, CB and OXT stay."""
    has = F.max(F.when((F.col("atom") == "CA") & (F.col("element") == "C"), 1).otherwise(0)).over(W.partitionBy(*RESIDUE))
    return atoms.withColumn("_ca", has).where((F.col("_ca") == 0) | F.col("atom").isin("N", "CA", "C", "O", "CB", "OXT")).drop("_ca")


def backbone(atoms: DataFrame) -> DataFrame:
    """A row a residue with n, ca, c, o as structs of x, y, z (first conformer)."""
    pick = lambda name: F.max(F.when(F.col("atom") == name, F.struct("x", "y", "z"))).alias(name.lower())
    return first_conformer(atoms).groupBy(*RESIDUE, "seqnum", "icode", "resname").agg(*(pick(a) for a in ("N", "CA", "C", "O")))


def _vec(c: str | Column) -> Vec:
    c = F.col(c) if isinstance(c, str) else c
    return c["x"], c["y"], c["z"]


def torsions(residues: DataFrame, max_bond: float = 2.0) -> DataFrame:
    """Adds phi, psi and omega in radians, null at the ends and where C-N is longer than max_bond."""
    w = W.partitionBy("model", "chain").orderBy("res_ord")
    r = residues.withColumns({"_pc": F.lag("c").over(w), "_nn": F.lead("n").over(w), "_nca": F.lead("ca").over(w)})
    joined = lambda a, b: dist2(_vec(a), _vec(b)) < max_bond * max_bond
    phi = F.when(joined("_pc", "n"), dihedral(_vec("_pc"), _vec("n"), _vec("ca"), _vec("c")))
    psi = F.when(joined("c", "_nn"), dihedral(_vec("n"), _vec("ca"), _vec("c"), _vec("_nn")))
    omega = F.when(joined("c", "_nn"), dihedral(_vec("ca"), _vec("c"), _vec("_nn"), _vec("_nca")))
    return r.withColumns({"phi": phi, "psi": psi, "omega": omega}).drop("_pc", "_nn", "_nca")


def neighbours_in_sequence(residues: DataFrame) -> DataFrame:
    """Adds the previous and next residue's number and name."""
    w = W.partitionBy("model", "chain").orderBy("res_ord")
    return residues.withColumns({"prev_seqnum": F.lag("seqnum").over(w), "prev_resname": F.lag("resname").over(w), "next_seqnum": F.lead("seqnum").over(w), "next_resname": F.lead("resname").over(w)})


def numbering_gaps(residues: DataFrame) -> DataFrame:
    """Residues whose number does not follow the one before."""
    w = W.partitionBy("model", "chain").orderBy("res_ord")
    return residues.withColumn("step", F.col("seqnum") - F.lag("seqnum").over(w)).where("step <> 1")


def mass_and_centre(atoms: DataFrame, keys: list[str]) -> DataFrame:
    m = table_lookup(F.upper("element"), WEIGHTS, 0.0) * F.col("occ")
    a = atoms.withColumn("_m", m)
    return a.groupBy(*keys).agg(F.sum("_m").alias("mass"), *((F.sum(F.col("_m") * F.col(c)) / F.sum("_m")).alias(f"centre_{c}") for c in "xyz"))


def bounding_box(atoms: DataFrame, keys: list[str], margin: float = 0.0) -> DataFrame:
    return atoms.groupBy(*keys).agg(*((F.min(c) - margin).alias(f"min_{c}") for c in "xyz"), *((F.max(c) + margin).alias(f"max_{c}") for c in "xyz"))


def counts(atoms: DataFrame, keys: list[str]) -> DataFrame:
    return atoms.groupBy(*keys).agg(F.count("*").alias("sites"), F.sum("occ").alias("occupancy"), F.countDistinct("chain", "res_ord").alias("residues"), F.min("b_iso").alias("b_min"), F.max("b_iso").alias("b_max"))


def sequences(residues: DataFrame) -> DataFrame:
    """One-letter sequence of each chain in order, (XXX) for other residues."""
    one = table_lookup(F.col("resname"), AMINO)
    r = residues.withColumn("_one", F.coalesce(one, F.concat(F.lit("("), "resname", F.lit(")"))))
    return r.groupBy("model", "chain").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("res_ord", "_one"))), lambda x: x["_one"]), "").alias("sequence"))


def sequence_weight(names: Column, unknown: float = 100.0) -> Column:
    """Weight of a chain of residue names: the sum less water for every bond."""
    total = F.aggregate(F.transform(names, lambda n: table_lookup(n, AMINO_WEIGHTS, unknown)), F.lit(0.0), lambda a, b: a + b)
    return F.when(F.size(names) > 0, total - (F.size(names) - 1) * 18.015).otherwise(0.0)


def polymer_types(residues: DataFrame) -> DataFrame:
    """Per chain: peptide where amino acids, with a bonus for ATOM records, are more than half."""
    aa = F.count_if(F.col("resname").isin(list(AMINO)))
    na = F.count_if(F.col("resname").isin("A", "C", "G", "U", "I", "DA", "DC", "DG", "DT", "DI", "DU"))
    bonus = F.max(F.when(F.col("group_pdb") == "ATOM", 1).otherwise(0)) if "group_pdb" in residues.columns else F.lit(1)
    total = F.count("*")
    return residues.groupBy("model", "chain").agg(F.when(2 * aa + bonus > total, "peptide").when(2 * na + bonus > total, "nucleic").otherwise("other").alias("polymer_type"))


def entity_types(atoms: DataFrame) -> DataFrame:
    """Adds entity_type: water, polymer (residues of a polymer chain's kinds) or non-polymer."""
    from .selection import WATER

    known = F.col("resname").isin(list(AMINO)) | F.col("resname").isin("A", "C", "G", "U", "DA", "DC", "DG", "DT")
    return atoms.withColumn("entity_type", F.when(F.col("resname").isin(WATER), "water").when(known, "polymer").otherwise("non-polymer"))


def serials(atoms: DataFrame, first: int = 1) -> DataFrame:
    """Serial numbers by order within a model."""
    return atoms.withColumn("serial", F.row_number().over(W.partitionBy("model").orderBy("atom_ord")) + (first - 1))


def renamed(atoms: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    return atoms.withColumn(column, F.coalesce(table_lookup(F.col(column), names), F.col(column)))


def transformed_atoms(atoms: DataFrame, rot, tran) -> DataFrame:
    new = [sum((float(r[j]) * F.col(c) for j, c in ((1, "y"), (2, "z"))), float(r[0]) * F.col("x")) + float(t) for r, t in zip(rot, tran, strict=True)]
    return atoms.withColumns(dict(zip("xyz", new, strict=True)))


def clamped(atoms: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return atoms.withColumn(column, F.least(F.greatest(F.col(column), F.lit(low)), F.lit(high)))


def matthews(volume: Column, weight: Column, n_images: Column) -> dict[str, Column]:
    """Matthews coefficient and solvent percentages for protein densities 1.35 and 1.34."""
    vm = volume / n_images / weight
    return {"vm": vm, "solvent_135": 100 * (1 - 1 / (1.35 * vm * 0.602214)), "solvent_134": 100 * (1 - 1 / (1.34 * vm * 0.602214))}


def secondary_structure(residues: DataFrame, ranges: DataFrame) -> DataFrame:
    """Adds ss from ranges (chain, first, last, ss) of residue numbers: an interval join on the chain."""
    r = small(ranges.select(F.col("chain").alias("_chain"), "first", "last", "ss"))
    return residues.join(r, (residues["chain"] == F.col("_chain")) & residues["seqnum"].between(F.col("first"), F.col("last")), "left").drop("_chain", "first", "last")


def rmsz(values: DataFrame, keys: list[str], cutoff: float = 2.0) -> DataFrame:
    """Per kind: count, root mean square Z of (value - ideal) / esd, and how many pass the cutoff."""
    z = (F.col("value") - F.col("ideal")) / F.col("esd")
    return values.where("esd > 0").groupBy(*keys).agg(F.count("*").alias("n"), F.sqrt(F.avg(z * z)).alias("rmsz"), F.count_if(F.abs(z) > cutoff).alias("outliers"))
