"""Whole analyses over an archive of files, as plans over items and atoms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import cif_string
from ..operators.chemistry import formula_weight
from ..operators.cif_query import BLOCK, category, find_values
from ..operators.model import backbone, matthews, torsions


def residue_frequency(items: DataFrame) -> DataFrame:
    """How often each monomer stands in the sequences of protein entities, per file."""
    seq = category(items, "entity_poly_seq", ["entity_id", "mon_id"])
    poly = category(items, "entity_poly", ["entity_id", "type"]).where(F.lower("type").contains("polypeptide")).select(*BLOCK, "entity_id").distinct()
    return seq.join(poly, [*BLOCK, "entity_id"], "left_semi").groupBy("path", cif_string(F.col("mon_id")).alias("mon_id")).agg(F.count("*").alias("n"))


def blocks_with_many(items: DataFrame, tag: str, more_than: int) -> DataFrame:
    return find_values(items, tag).groupBy(*BLOCK).agg(F.count("*").alias("n")).where(F.col("n") > more_than)


def column_order(items: DataFrame, name: str, usual: list[str]) -> DataFrame:
    """Per file: the usual columns that a category lacks, and whether the others stand in the usual order."""
    cols = items.where((F.lower("category") == name) & (F.coalesce("row_idx", F.lit(0)) == 0)).groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("col_idx", F.split_part("tag", F.lit("."), F.lit(2)).alias("c")))), lambda x: x["c"]).alias("have"))
    want = F.array(*map(F.lit, usual))
    return cols.select("path", F.array_except(want, "have").alias("missing"), (F.filter("have", lambda c: F.array_contains(want, c)) == F.filter(want, lambda c: F.array_contains(F.col("have"), c))).alias("in_order"))


def formula_check(entities: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Rows (id, formula, weight) whose stated weight strays from the formula's."""
    return entities.withColumn("calculated", formula_weight(F.col("formula"))).where(F.abs(F.col("calculated") - F.col("weight")) > tolerance)


def matthews_survey(entries: DataFrame) -> DataFrame:
    """Vm and solvent content of entries (volume, weight, n_images)."""
    return entries.withColumns(matthews(F.col("volume"), F.col("weight"), F.col("n_images")))


def long_chains(atoms: DataFrame, cell, limit: float = 1.2) -> DataFrame:
    """Chains whose fractional extent passes the limit along an axis."""
    f = cell.fractional(F.col("x"), F.col("y"), F.col("z"))
    a = atoms.withColumns({f"f{c}": v for c, v in zip("xyz", f, strict=True)})
    e = a.groupBy("path", "model", "chain").agg(*((F.max(f"f{c}") - F.min(f"f{c}")).alias(f"extent_{c}") for c in "xyz"))
    return e.where(F.greatest("extent_x", "extent_y", "extent_z") > limit)


def ramachandran(atoms: DataFrame) -> DataFrame:
    """phi and psi in degrees by residue name, of residues that have both."""
    t = torsions(backbone(atoms)).where("phi is not null and psi is not null")
    return t.select("model", "chain", "seqnum", "resname", F.degrees("phi").alias("phi"), F.degrees("psi").alias("psi"))


def reflection_statistics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per block: rows, unique hkl, and whether duplicates stand alone (N), as Friedel mates (F) or otherwise (Y)."""
    folded = F.when((F.col("h") < 0) | ((F.col("h") == 0) & ((F.col("k") < 0) | ((F.col("k") == 0) & (F.col("l") < 0)))), F.struct(*((-F.col(c)).alias(c) for c in "hkl"))).otherwise(F.struct("h", "k", "l"))
    r = rows.withColumn("_m", folded)
    g = r.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.countDistinct("h", "k", "l").alias("unique_hkl"), F.countDistinct("_m").alias("unique_mates"))
    return g.withColumn("duplicates", F.when(F.col("n_rows") > F.col("unique_hkl"), "Y").when(F.col("unique_hkl") > F.col("unique_mates"), "F").otherwise("N"))


def signal(rows: DataFrame, cell) -> DataFrame:
    """1/d squared and I over sigma of each reflection, for a scatter or a histogram."""
    return rows.where("sigma > 0").select(cell.inv_d2(F.col("h"), F.col("k"), F.col("l")).alias("inv_d2"), (F.col("value") / F.col("sigma")).alias("i_sigma"))


def mask_confusion(a: DataFrame, b: DataFrame) -> DataFrame:
    """2 x 2 counts of two masks (u, v, w, value), values rounded to 0 or 1."""
    j = a.select("u", "v", "w", F.round("value").cast("int").alias("first")).join(b.select("u", "v", "w", F.round("value").cast("int").alias("second")), ["u", "v", "w"])
    return j.groupBy("first", "second").agg(F.count("*").alias("n"))


def used_components(dictionary: DataFrame, atoms: DataFrame) -> DataFrame:
    """Items of a component dictionary for the residue names in use."""
    used = atoms.select(F.col("resname").alias("block")).distinct()
    return dictionary.join(used, "block", "left_semi")


def columns_that_differ(items: DataFrame, name: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """How many rows of a category differ between columns that often agree (auth and label ones)."""
    t = category(items, name, sorted({c for p in pairs for c in p}))
    return t.groupBy("path").agg(*(F.count_if(F.col(a) != F.col(b)).alias(f"{a}__{b}") for a, b in pairs))
