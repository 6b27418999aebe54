"""Domain tables from CIF items: reflections, components, small molecules, dictionaries; and their way back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.values import cif_int, cif_number, cif_quoted, cif_string, is_null
from ..operators.cif_query import BLOCK, category, find_value

# Tag in _refln, name here.
MERGED = [
    ("index_h", "h"), ("index_k", "k"), ("index_l", "l"), ("status", "status"), ("pdbx_r_free_flag", "free"), ("F_meas_au", "fp"), ("F_meas_sigma_au", "sigfp"), ("intensity_meas", "i"), ("intensity_sigma", "sigi"),
    ("pdbx_F_plus", "f_plus"), ("pdbx_F_plus_sigma", "sigf_plus"), ("pdbx_F_minus", "f_minus"), ("pdbx_F_minus_sigma", "sigf_minus"), ("F_calc", "fc"), ("phase_calc", "phic"), ("pdbx_FWT", "fwt"), ("pdbx_PHWT", "phwt"), ("fom", "fom"),
    ("pdbx_HL_A_iso", "hla"), ("pdbx_HL_B_iso", "hlb"), ("pdbx_HL_C_iso", "hlc"), ("pdbx_HL_D_iso", "hld"),
]
UNMERGED = [("index_h", "h"), ("index_k", "k"), ("index_l", "l"), ("intensity_net", "value"), ("intensity_sigma", "sigma"), ("pdbx_image_id", "image"), ("scale_group_code", "scale_group")]


def reflections(items: DataFrame, unmerged: bool = False) -> DataFrame:
    """Rows of _refln (or _diffrn_refln) with h, k, l integers and the known columns as doubles; the status as a free flag: f is 0, o is 1."""
    table, spec = ("diffrn_refln", UNMERGED) if unmerged else ("refln", MERGED)
    t = category(items, table, [c for c, _ in spec])
    typed = [cif_int(F.col(c)).alias(n) if n in "hkl" else F.nullif(cif_string(F.col(c)), F.lit("")).alias(n) if n in ("status", "scale_group") else cif_number(F.col(c)).alias(n) for c, n in spec]
    out = t.select(*BLOCK, "row_idx", *typed).where("h is not null")
    if not unmerged:
        out = out.withColumn("free_flag", F.when(F.col("status") == "f", 0).when(F.col("status") == "o", 1))
    return out


def core_reflections(items: DataFrame) -> DataFrame:
    """Reflections of small-molecule hkl CIF files: h, k, l, observed and calculated F squared, sigma."""
    tags = {"h": "_refln_index_h", "k": "_refln_index_k", "l": "_refln_index_l", "f2_meas": "_refln_f_squared_meas", "f2_sigma": "_refln_f_squared_sigma", "f2_calc": "_refln_f_squared_calc"}
    t = items.where(F.lower("tag").isin(list(tags.values()))).groupBy(*BLOCK, "row_idx").agg(*(F.max(F.when(F.lower("tag") == v, F.col("value_raw"))).alias(k) for k, v in tags.items()))
    return t.select(*BLOCK, "row_idx", *((cif_int if k in "hkl" else cif_number)(F.col(k)).alias(k) for k in tags))


# A column of SF-mmCIF, its MTZ label and type; a label that is taken passes on to the next.
TO_MTZ = [("free_flag", "FreeR_flag", "I"), ("fp", "FP", "F"), ("sigfp", "SIGFP", "Q"), ("i", "I", "J"), ("sigi", "SIGI", "Q"), ("f_plus", "F(+)", "G"), ("sigf_plus", "SIGF(+)", "L"), ("f_minus", "F(-)", "G"), ("sigf_minus", "SIGF(-)", "L"), ("fc", "FC", "F"), ("phic", "PHIC", "P"), ("fwt", "FWT", "F"), ("phwt", "PHWT", "P"), ("fom", "FOM", "W"), ("hla", "HLA", "A"), ("hlb", "HLB", "A"), ("hlc", "HLC", "A"), ("hld", "HLD", "A")]


def mtz_columns(rows: DataFrame) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Reflections with MTZ labels, and the labels with their types: those of the columns that hold a value."""
    there = [(c, label, kind) for c, label, kind in TO_MTZ if c in rows.columns]
    filled = rows.agg(*(F.count(c).alias(c) for c, _, _ in there)).first()
    kept = [(c, label, kind) for c, label, kind in there if filled[c]]
    return rows.select("h", "k", "l", *(F.col(c).alias(label) for c, label, _ in kept)), [(label, kind) for _, label, kind in kept]


def deposition_problems(rows: DataFrame) -> list[str]:
    """What a reflection table lacks for a deposition: amplitudes or intensities with sigmas, free flags, positive sigmas."""
    c, out = set(rows.columns), []
    if not ({"fp", "sigfp"} <= c or {"i", "sigi"} <= c or {"f_plus", "f_minus"} <= c):
        out.append("no amplitudes or intensities with sigmas")
    if "free_flag" not in c:
        out.append("no free flags")
    for s in ("sigfp", "sigi"):
        if s in c and rows.where(F.col(s) <= 0).limit(1).count():
            out.append(f"{s} is not positive everywhere")
    return out


def block_cells(items: DataFrame) -> DataFrame:
    """Cell and space group of each block; blocks that lack them take the file's first known ones."""
    names = ["length_a", "length_b", "length_c", "angle_alpha", "angle_beta", "angle_gamma"]
    blocks = items.select(*BLOCK).distinct()
    for n in names:
        v = find_value(items, f"_cell.{n}").select(*BLOCK, cif_number(F.col("value_raw")).alias(n))
        blocks = blocks.join(v, BLOCK, "left")
    sg = find_value(items, "_symmetry.space_group_name_H-M").select(*BLOCK, cif_string(F.col("value_raw")).alias("spacegroup"))
    blocks = blocks.join(sg, BLOCK, "left")
    w = W.partitionBy("path").orderBy("block_idx").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return blocks.select(*BLOCK, *(F.coalesce(c, F.first(c, True).over(w)).alias(c) for c in [*names, "spacegroup"]))


def block_with(items: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """The first block of each file whose category has all the columns."""
    have = items.where(F.lower("category") == table.lower()).groupBy(*BLOCK).agg(F.collect_set(F.lower(F.split_part("tag", F.lit("."), F.lit(2)))).alias("_c"))
    ok = have.where(F.size(F.array_except(F.array(*(F.lit(c.lower()) for c in columns)), F.col("_c"))) == 0)
    return ok.groupBy("path").agg(F.min_by(F.struct("block_idx", "block"), "block_idx").alias("b")).select("path", "b.*")


def anomalous_columns(rows: DataFrame, group) -> DataFrame:
    """Old-style anomalous rows (hkl and -hkl of f, sigf) as one row with f_plus, sigf_plus, f_minus, sigf_minus."""
    a = rows.withColumn("_a", group.to_asu(F.col("h"), F.col("k"), F.col("l")))
    plus = F.col("_a.isym") % 2 == 1
    pick = lambda c, s: F.max(F.when(s, F.col(c)))
    return a.groupBy(F.col("_a.h").alias("h"), F.col("_a.k").alias("k"), F.col("_a.l").alias("l")).agg(pick("f", plus).alias("f_plus"), pick("sigf", plus).alias("sigf_plus"), pick("f", ~plus).alias("f_minus"), pick("sigf", ~plus).alias("sigf_minus"))


def refln_items(rows: DataFrame, block: str) -> DataFrame:
    """Reflections (h, k, l and known names) as CIF items of a _refln loop, for sources.cif.to_cif_text."""
    spec = [(t, n) for t, n in MERGED if n in rows.columns]
    at = F.row_number().over(W.orderBy("h", "k", "l")) - 1  # a file's rows in order
    cells = F.array(*(F.struct(F.lit(i).alias("col_idx"), F.lit(f"_refln.{t}").alias("tag"), F.coalesce(F.col(n).cast("string"), F.lit("?")).alias("value_raw")) for i, (t, n) in enumerate(spec)))
    out = rows.withColumn("row_idx", at).select("row_idx", F.inline(cells))
    return out.select(F.lit(block).alias("path"), F.lit(0).alias("block_idx"), F.lit(block).alias("block"), F.lit(None).cast("string").alias("frame"), F.lit(0).alias("item_idx"), F.lit("loop").alias("kind"), F.lit("refln").alias("category"), "tag", "row_idx", "col_idx", "value_raw")


def table_items(rows: DataFrame, block: str, name: str, item_idx: int = 0) -> DataFrame:
    """Any table as a CIF loop: strings are quoted where needed, nulls are '?'."""
    at = F.row_number().over(W.orderBy(*rows.columns)) - 1
    cells = F.array(*(F.struct(F.lit(i).alias("col_idx"), F.lit(f"_{name}.{c}").alias("tag"), F.coalesce(cif_quoted(F.col(c)) if t == "string" else F.col(c).cast("string"), F.lit("?")).alias("value_raw")) for i, (c, t) in enumerate(rows.dtypes)))
    out = rows.withColumn("row_idx", at).select("row_idx", F.inline(cells))
    return out.select(F.lit(block).alias("path"), F.lit(0).alias("block_idx"), F.lit(block).alias("block"), F.lit(None).cast("string").alias("frame"), F.lit(item_idx).alias("item_idx"), F.lit("loop").alias("kind"), F.lit(name).alias("category"), "tag", "row_idx", "col_idx", "value_raw")


def component_atoms(items: DataFrame) -> DataFrame:
    """Atoms of chemical components: comp_id, name, element, charge and three sets of coordinates (given, example, ideal)."""
    c = ["comp_id", "atom_id", "type_symbol", "charge", "x", "y", "z", "model_Cartn_x", "model_Cartn_y", "model_Cartn_z", "pdbx_model_Cartn_x_ideal", "pdbx_model_Cartn_y_ideal", "pdbx_model_Cartn_z_ideal"]
    t = category(items, "chem_comp_atom", c)
    xyz = lambda p, s="": F.struct(*(cif_number(F.col(f"{p}{a}{s}")).alias(a) for a in "xyz"))
    return t.select(*BLOCK, "row_idx", cif_string(F.col("comp_id")).alias("comp_id"), cif_string(F.col("atom_id")).alias("name"), F.initcap(cif_string(F.col("type_symbol"))).alias("element"), F.coalesce(cif_number(F.col("charge")), F.lit(0.0)).alias("charge"), xyz("").alias("xyz"), xyz("model_Cartn_").alias("example"), xyz("pdbx_model_Cartn_", "_ideal").alias("ideal"))


def component_bonds(items: DataFrame) -> DataFrame:
    t = category(items, "chem_comp_bond", ["comp_id", "atom_id_1", "atom_id_2", "type", "value_order", "aromatic", "pdbx_aromatic_flag", "value_dist", "value_dist_esd"])
    order = F.upper(F.substring(F.coalesce(F.nullif(cif_string(F.col("value_order")), F.lit("")), cif_string(F.col("type"))), 1, 4))
    aromatic = F.lower(F.coalesce("pdbx_aromatic_flag", "aromatic", F.lit("n"))).startswith("y")
    return t.select(*BLOCK, cif_string(F.col("comp_id")).alias("comp_id"), cif_string(F.col("atom_id_1")).alias("a"), cif_string(F.col("atom_id_2")).alias("b"), F.when(aromatic, "AROM").otherwise(order).alias("order"), cif_number(F.col("value_dist")).alias("ideal"), cif_number(F.col("value_dist_esd")).alias("esd"))


def component_angles(items: DataFrame) -> DataFrame:
    t = category(items, "chem_comp_angle", ["comp_id", "atom_id_1", "atom_id_2", "atom_id_3", "value_angle", "value_angle_esd"])
    return t.select(*BLOCK, *(cif_string(F.col(c)).alias(n) for c, n in (("comp_id", "comp_id"), ("atom_id_1", "atom1"), ("atom_id_2", "atom2"), ("atom_id_3", "atom3"))), cif_number(F.col("value_angle")).alias("ideal"), cif_number(F.col("value_angle_esd")).alias("esd"))


def component_models(atoms: DataFrame) -> DataFrame:
    """Components as coordinates: a model for each kind of coordinates that is there."""
    kinds = F.array(*(F.struct(F.lit(i).alias("model"), F.col(c).alias("p")) for i, c in enumerate(("xyz", "example", "ideal"), 1)))
    e = atoms.withColumn("_k", F.explode(kinds)).where("_k.p.x is not null")
    return e.select("comp_id", F.col("_k.model").alias("model"), "name", "element", "charge", "row_idx", F.col("_k.p.x").alias("x"), F.col("_k.p.y").alias("y"), F.col("_k.p.z").alias("z"))


def small_molecule_sites(items: DataFrame) -> DataFrame:
    """Sites of core CIF files: label, element, fx, fy, fz, occ, u_iso."""
    tags = {"label": "_atom_site_label", "type": "_atom_site_type_symbol", "fx": "_atom_site_fract_x", "fy": "_atom_site_fract_y", "fz": "_atom_site_fract_z", "occ": "_atom_site_occupancy", "u_iso": "_atom_site_U_iso_or_equiv"}
    rows = items.where(F.lower("tag").isin([t.lower() for t in tags.values()]))
    t = rows.groupBy(*BLOCK, "row_idx").agg(*(F.max(F.when(F.lower("tag") == v.lower(), F.col("value_raw"))).alias(k) for k, v in tags.items()))
    label = cif_string(F.col("label"))
    element = F.initcap(F.regexp_extract(F.coalesce(F.nullif(cif_string(F.col("type")), F.lit("")), label), "^([A-Za-z]{1,2})", 1))
    n = lambda c: cif_number(F.col(c))
    return t.select(*BLOCK, "row_idx", label.alias("label"), element.alias("element"), n("fx").alias("fx"), n("fy").alias("fy"), n("fz").alias("fz"), F.coalesce(n("occ"), F.lit(1.0)).alias("occ"), n("u_iso").alias("u_iso"))


def small_molecule_operations(items: DataFrame) -> DataFrame:
    tags = ["_symmetry_equiv_pos_as_xyz", "_space_group_symop_operation_xyz"]
    return items.where(F.lower("tag").isin(tags)).select(*BLOCK, "row_idx", F.regexp_replace(cif_string(F.col("value_raw")), r"\s", "").alias("triplet"))


def dictionary_rules(items: DataFrame) -> DataFrame:
    """Rules of a DDL2 dictionary's save frames for operators.cif_query: tag, type_regex, enumeration, low, high, mandatory."""
    at = ["path", "block_idx", "frame"]
    v = lambda t: F.max(F.when(F.lower("tag") == t, cif_string(F.col("value_raw"))))
    many = lambda t: F.collect_list(F.when((F.lower("tag") == t) & ~is_null(F.col("value_raw")), cif_string(F.col("value_raw"))))
    number = lambda t, f: f(F.when(F.lower("tag") == t, cif_number(F.col("value_raw"))))
    frames = items.where("frame is not null").groupBy(*at).agg(v("_item.name").alias("tag"), v("_item_type.code").alias("code"), many("_item_enumeration.value").alias("_e"), number("_item_range.minimum", F.min).alias("low"), number("_item_range.maximum", F.max).alias("high"), (v("_item.mandatory_code") == "yes").alias("mandatory"))
    codes = category(items.where("frame is null"), "item_type_list", ["code", "construct"]).select("path", F.col("code"), cif_string(F.col("construct")).alias("type_regex"))
    out = frames.where("tag is not null").join(codes, ["path", "code"], "left")
    return out.select("tag", "type_regex", F.when(F.size("_e") > 0, F.col("_e")).alias("enumeration"), "low", "high", F.coalesce("mandatory", F.lit(False)).alias("mandatory"))


def dictionary_parents(items: DataFrame) -> DataFrame:
    """Child and parent tags of a DDL2 dictionary's links."""
    t = category(items, "item_linked", ["child_name", "parent_name"])
    return t.select(cif_string(F.col("child_name")).alias("child"), cif_string(F.col("parent_name")).alias("parent"))


def _bricks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = np.frombuffer(content[:512], ">i2" if np.frombuffer(content[36:38], ">i2")[0] == 100 else "<i2")
            start, extent, rate = words[0:3], words[3:6], words[6:9]
            prod, plus = words[15] / 100, words[16]
            swapped = np.frombuffer(content[36:38], ">i2")[0] != 100
            nb = [-(-int(e) // 8) for e in extent]
            rows = []
            for b, (bz, by, bx) in enumerate((z, y, x) for z in range(nb[2]) for y in range(nb[1]) for x in range(nb[0])):
                raw = np.frombuffer(content[512 + 512 * b : 1024 + 512 * b], np.uint8)
                raw = raw.reshape(-1, 2)[:, ::-1].ravel() if not swapped else raw
                brick = (raw.astype(float).reshape(8, 8, 8) - plus) / prod
                z, y, x = (g.ravel() for g in np.indices((8, 8, 8)))
                u, v, w = x + 8 * bx, y + 8 * by, z + 8 * bz
                keep = (u < extent[0]) & (v < extent[1]) & (w < extent[2])
                rows.append((u[keep] + start[0], v[keep] + start[1], w[keep] + start[2], brick.ravel()[keep]))
            u, v, w, value = (np.concatenate(c) for c in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(u)), *(pa.array(np.mod(a, int(n)).astype(np.int32)) for a, n in zip((u, v, w), rate, strict=True)), pa.array(value)], ["path", "u", "v", "w", "value"])


def read_dsn6(spark: SparkSession, path: str) -> DataFrame:
    """Grid points of DSN6 maps: bricks of 8 x 8 x 8 bytes."""
    from ..session import ship_package

    ship_package(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_bricks, "path string, u int, v int, w int, value double")


def walk(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Files under a folder, recursively: path, kind (coordinates, reflections, map, cif, other), modificationTime, length."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder).drop("content")
    p = F.regexp_replace(F.lower("path"), r"\.gz$", "")
    kind = F.when(p.rlike(r"sf\.ent$|\.mtz$|\.hkl$|-sf\.cif$"), "reflections").when(p.rlike(r"\.(pdb|ent|mmcif)$"), "coordinates").when(p.rlike(r"\.(ccp4|mrc|map|dsn6|omap)$"), "map").when(p.rlike(r"\.(cif|mmjson|json)$"), "cif").otherwise("other")
    return files.withColumn("kind", kind).orderBy("path")


def entry_url(code: str, cif: bool = True) -> str:
    """Address of an entry at the archive's download site; nothing is fetched."""
    return f"https://files.rcsb.org/download/{code.upper()}.{'cif' if cif else 'pdb'}.gz"
