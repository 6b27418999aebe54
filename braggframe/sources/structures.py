"""Coordinate files as atom tables: PDB by Spark's text reader, mmCIF through sources.cif; PDB and mmCIF out again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.cif_query import category

ATOMS = ["path", "model", "chain", "seqnum", "icode", "resname", "atom", "altloc", "element", "charge", "x", "y", "z", "occ", "b_iso", "serial", "group_pdb"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value"))
    return text.select("path", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def read_pdb(spark: SparkSession, path: str, ignore_ter: bool = False, split_chain_on_ter: bool = False) -> DataFrame:
    """Atoms of PDB files by their fixed columns, with atom_ord and res_ord. A file is one row until its lines are cut."""
    cut = lambda a, b: F.substring(F.rpad("line", 80, " "), a, b - a + 1)
    rows = _lines(spark, path).withColumn("rec", F.rtrim(cut(1, 6)))
    w = W.partitionBy("path").orderBy("line_no")
    rows = rows.where(F.col("rec").isin("ATOM", "HETATM", "MODEL", "TER"))
    rows = rows.withColumn("model", F.coalesce(F.last(F.when(F.col("rec") == "MODEL", F.trim(cut(11, 14)).try_cast("int")), True).over(w), F.lit(1)))
    rows = rows.withColumn("_ter", F.count_if(F.col("rec") == "TER").over(w))
    num = lambda a, b, t: F.trim(cut(a, b)).try_cast(t)
    a = rows.where(F.col("rec").isin("ATOM", "HETATM")).select(
        "path", "line_no", "model", F.trim(cut(21, 22)).alias("chain"), num(23, 26, "int").alias("seqnum"), F.trim(cut(27, 27)).alias("icode"), F.trim(cut(18, 20)).alias("resname"),
        F.trim(cut(13, 16)).alias("atom"), F.trim(cut(17, 17)).alias("altloc"),
        F.when(F.trim(cut(77, 78)) != "", F.initcap(F.trim(cut(77, 78)))).otherwise(F.initcap(F.regexp_extract(F.trim(cut(13, 14)), "[A-Za-z]+", 0))).alias("element"),
        F.when(cut(79, 80).rlike("[0-9][+-]"), F.concat(cut(80, 80), cut(79, 79)).try_cast("int")).otherwise(0).alias("charge"),
        num(31, 38, "double").alias("x"), num(39, 46, "double").alias("y"), num(47, 54, "double").alias("z"),
        F.coalesce(num(55, 60, "double"), F.lit(1.0)).alias("occ"), F.coalesce(num(61, 66, "double"), F.lit(0.0)).alias("b_iso"), num(7, 11, "int").alias("serial"), F.col("rec").alias("group_pdb"), "_ter",
    )
    if split_chain_on_ter and not ignore_ter:
        a = a.withColumn("chain", F.concat("chain", F.when(F.col("_ter") > 0, F.col("_ter").cast("string")).otherwise("")))
    return with_order(a.drop("_ter"), "line_no").drop("line_no")


def with_order(atoms: DataFrame, place: str) -> DataFrame:
    """Adds atom_ord (place in the file) and res_ord (a number a residue, by chain, in order)."""
    w = W.partitionBy("path", "model", "chain").orderBy(place)
    new = ~(F.struct("seqnum", "icode", "resname").eqNullSafe(F.lag(F.struct("seqnum", "icode", "resname")).over(w)))
    return atoms.withColumn("atom_ord", F.col(place).cast("int")).withColumn("_new", F.when(new, 1).otherwise(0)).withColumn("res_ord", F.sum("_new").over(w).cast("int")).drop("_new")


def read_pdb_cell(spark: SparkSession, path: str) -> DataFrame:
    """CRYST1 of each file: a, b, c, alpha, beta, gamma, spacegroup."""
    rows = _lines(spark, path).where("line like 'CRYST1%'")
    n = lambda a, b: F.trim(F.substring("line", a, b - a + 1)).try_cast("double")
    return rows.select("path", n(7, 15).alias("a"), n(16, 24).alias("b"), n(25, 33).alias("c"), n(34, 40).alias("alpha"), n(41, 47).alias("beta"), n(48, 54).alias("gamma"), F.trim(F.substring("line", 56, 11)).alias("spacegroup"))


def remark_290(spark: SparkSession, path: str) -> DataFrame:
    """Symmetry triplets that PDB remarks list."""
    return _lines(spark, path).select("path", F.regexp_extract("line", r"^REMARK 290\s+(\d+)555\s+(\S+,\S+,\S+)", 1).try_cast("int").alias("number"), F.regexp_extract("line", r"^REMARK 290\s+\d+555\s+(\S+,\S+,\S+)", 1).alias("triplet")).where("triplet <> ''")


def atoms_from_cif(items: DataFrame) -> DataFrame:
    """Atoms of the _atom_site category; auth identifiers go before label ones."""
    from ..functions.values import cif_number, cif_string

    cols = ["group_PDB", "id", "type_symbol", "label_atom_id", "auth_atom_id", "label_alt_id", "label_comp_id", "auth_comp_id", "label_asym_id", "auth_asym_id", "label_seq_id", "auth_seq_id", "pdbx_PDB_ins_code", "Cartn_x", "Cartn_y", "Cartn_z", "occupancy", "B_iso_or_equiv", "pdbx_formal_charge", "pdbx_PDB_model_num"]
    t = category(items, "atom_site", cols)
    s = lambda c: F.nullif(cif_string(F.col(c)), F.lit(""))
    n = lambda c, kind="double": cif_number(F.col(c)).cast(kind)
    a = t.select(
        "path", "row_idx", F.coalesce(n("pdbx_PDB_model_num", "int"), F.lit(1)).alias("model"), F.coalesce(s("auth_asym_id"), s("label_asym_id")).alias("chain"),
        F.coalesce(n("auth_seq_id", "int"), n("label_seq_id", "int")).alias("seqnum"), F.coalesce(s("pdbx_PDB_ins_code"), F.lit("")).alias("icode"), F.coalesce(s("auth_comp_id"), s("label_comp_id")).alias("resname"),
        F.coalesce(s("auth_atom_id"), s("label_atom_id")).alias("atom"), F.coalesce(s("label_alt_id"), F.lit("")).alias("altloc"), F.initcap(s("type_symbol")).alias("element"), F.coalesce(n("pdbx_formal_charge", "int"), F.lit(0)).alias("charge"),
        n("Cartn_x").alias("x"), n("Cartn_y").alias("y"), n("Cartn_z").alias("z"), F.coalesce(n("occupancy"), F.lit(1.0)).alias("occ"), F.coalesce(n("B_iso_or_equiv"), F.lit(0.0)).alias("b_iso"), n("id", "int").alias("serial"), s("group_PDB").alias("group_pdb"),
    )
    return with_order(a, "row_idx").drop("row_idx")


def pdb_lines(atoms: DataFrame) -> DataFrame:
    """Fixed-column ATOM and HETATM lines, in order."""
    name = F.when((F.length("atom") >= 4) | (F.length("element") == 2), F.rpad("atom", 4, " ")).otherwise(F.rpad(F.concat(F.lit(" "), "atom"), 4, " "))
    blank = lambda c: F.rpad(F.coalesce(c, F.lit("")), 1, " ")
    f = lambda c, n, d: F.lpad(F.format_string(f"%.{d}f", c), n, " ")
    line = F.concat(
        F.rpad("group_pdb", 6, " "), F.lpad(F.col("serial").cast("string"), 5, " "), F.lit(" "), name, blank(F.col("altloc")), F.lpad("resname", 3, " "), F.lpad("chain", 2, " "), F.lpad(F.col("seqnum").cast("string"), 4, " "), blank(F.col("icode")), F.lit("   "),
        f("x", 8, 3), f("y", 8, 3), f("z", 8, 3), f("occ", 6, 2), f("b_iso", 6, 2), F.lit(" " * 10), F.lpad(F.upper("element"), 2, " "), F.when(F.col("charge") != 0, F.concat(F.abs("charge").cast("string"), F.when(F.col("charge") > 0, "+").otherwise("-"))).otherwise("  "),
    )
    return atoms.select("path", "model", "atom_ord", line.alias("line")).orderBy("path", "model", "atom_ord")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """header and seq of FASTA or PIR records; PIR joins its second header line; an asterisk ends a sequence."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.concat(F.lit("\n"), F.regexp_replace("value", "\r", "")).alias("value"))
    records = whole.select("path", F.posexplode(F.split("value", "\n>")).alias("ord", "r")).where("ord > 0")
    first, rest = F.substring_index("r", "\n", 1), F.expr("substring(r, instr(r, '\n') + 1)")
    pir = first.rlike(r"^(P1|F1|DL|DC|RL|RC|N1|N3|XX);")
    second = F.substring_index(rest, "\n", 1)
    body = F.when(pir, F.expr("substring(substring(r, instr(r, '\n') + 1), instr(substring(r, instr(r, '\n') + 1), '\n') + 1)")).otherwise(rest)
    return records.select("path", "ord", F.when(pir, F.concat_ws(" ", first, second)).otherwise(first).alias("header"), F.regexp_replace(F.substring_index(body, "*", 1), r"\s", "").alias("seq"))


def coordinate_format(path):
    """Format of a coordinate file by its name, as a Column: pdb, mmcif, mmjson or unknown."""
    p = F.regexp_replace(F.lower(path), r"\.gz$", "")
    return F.when(p.rlike(r"\.(pdb|ent)$"), "pdb").when(p.rlike(r"\.(cif|mmcif)$"), "mmcif").when(p.rlike(r"\.(json|mmjson|js)$"), "mmjson").otherwise("unknown")


def read_structure(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Atoms of one kind of files under a path; the kind is read off the path if not given."""
    from .cif import read_cif

    kind = kind or ("pdb" if path.lower().removesuffix(".gz").endswith((".pdb", ".ent")) else "mmcif")
    return read_pdb(spark, path) if kind == "pdb" else atoms_from_cif(read_cif(spark, path))


def remark_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Resolution and R values that PDB remarks state, a row a file."""
    rows = _lines(spark, path).where("line like 'REMARK%'")
    number = lambda p: F.max(F.regexp_extract("line", p, 1).try_cast("double"))
    return rows.groupBy("path").agg(number(r"^REMARK   2 RESOLUTION\.\s+([\d.]+)").alias("resolution"), number(r"^REMARK   3   R VALUE\s+\(WORKING SET\)\s*:\s*([\d.]+)").alias("r_work"), number(r"^REMARK   3   FREE R VALUE\s*:\s*([\d.]+)").alias("r_free"))


def secondary_ranges(spark: SparkSession, path: str) -> DataFrame:
    """HELIX and SHEET records as ranges (chain, first, last, ss) for operators.model.secondary_structure."""
    rows = _lines(spark, path)
    cut = lambda a, b: F.trim(F.substring(F.rpad("line", 80, " "), a, b - a + 1))
    helix = rows.where("line like 'HELIX%'").select("path", cut(20, 20).alias("chain"), cut(22, 25).try_cast("int").alias("first"), cut(34, 37).try_cast("int").alias("last"), F.lit("H").alias("ss"))
    sheet = rows.where("line like 'SHEET%'").select("path", cut(22, 22).alias("chain"), cut(23, 26).try_cast("int").alias("first"), cut(34, 37).try_cast("int").alias("last"), F.lit("E").alias("ss"))
    return helix.unionByName(sheet)


def sequence_records(spark: SparkSession, path: str) -> DataFrame:
    """SEQRES as a list of residue names a chain."""
    rows = _lines(spark, path).where("line like 'SEQRES%'")
    names = F.filter(F.split(F.trim(F.substring("line", 20, 51)), r"\s+"), lambda x: x != "")
    r = rows.select("path", F.trim(F.substring("line", 12, 1)).alias("chain"), "line_no", names.alias("names"))
    return r.groupBy("path", "chain").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "names"))), lambda x: x["names"])).alias("names"))
