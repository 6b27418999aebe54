"""Records of PDB files beside the coordinates, by the fixed columns of the format, and what is joined to the atoms from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import hybrid36_int

# Columns of the PDB format, version 3.3: name, first and last column, kind (s: text, i: int, h: int in hybrid-36, f: double).
LAYOUTS = {
    "ANISOU": "serial 7 11 h, atom 13 16 s, altloc 17 17 s, resname 18 20 s, chain 21 22 s, seqnum 23 26 h, icode 27 27 s, u11 29 35 i, u22 36 42 i, u33 43 49 i, u12 50 56 i, u13 57 63 i, u23 64 70 i",
    "SSBOND": "number 8 10 i, resname_1 12 14 s, chain_1 15 16 s, seqnum_1 18 21 h, icode_1 22 22 s, resname_2 26 28 s, chain_2 29 30 s, seqnum_2 32 35 h, icode_2 36 36 s, symop_1 60 65 s, symop_2 67 72 s, length 74 78 f",
    "LINK": "atom_1 13 16 s, altloc_1 17 17 s, resname_1 18 20 s, chain_1 21 22 s, seqnum_1 23 26 h, icode_1 27 27 s, atom_2 43 46 s, altloc_2 47 47 s, resname_2 48 50 s, chain_2 51 52 s, seqnum_2 53 56 h, icode_2 57 57 s, symop_1 60 65 s, symop_2 67 72 s, length 74 78 f",
    "CISPEP": "number 8 10 i, resname_1 12 14 s, chain_1 15 16 s, seqnum_1 18 21 h, icode_1 22 22 s, resname_2 26 28 s, chain_2 29 30 s, seqnum_2 32 35 h, icode_2 36 36 s, model 44 46 i, angle 54 59 f",
    "MODRES": "entry 8 11 s, resname 13 15 s, chain 16 17 s, seqnum 19 22 h, icode 23 23 s, standard 25 27 s, details 30 70 s",
    "DBREF": "entry 8 11 s, chain 12 13 s, first 15 18 h, first_icode 19 19 s, last 21 24 h, last_icode 25 25 s, database 27 32 s, accession 34 41 s, code 43 54 s, db_first 56 60 i, db_last 63 67 i",
    "DBREF1": "entry 8 11 s, chain 12 13 s, first 15 18 h, first_icode 19 19 s, last 21 24 h, last_icode 25 25 s, database 27 32 s, code 48 67 s",
    "DBREF2": "accession 19 40 s, db_first 46 55 i, db_last 58 67 i",
    "HELIX": "number 8 10 i, name 12 14 s, chain 19 20 s, first 22 25 h, first_icode 26 26 s, end_chain 31 32 s, last 34 37 h, last_icode 38 38 s, kind 39 40 i, length 72 76 i",
    "SHEET": "strand 8 10 i, name 12 14 s, strands 15 16 i, chain 21 22 s, first 23 26 h, first_icode 27 27 s, end_chain 32 33 s, last 34 37 h, last_icode 38 38 s, sense 39 40 i",
    "SEQRES": "line 8 10 i, chain 11 12 s, count 14 17 i, residues 20 70 s",
    "MTRIX": "row 6 6 i, number 8 10 i, r1 11 20 f, r2 21 30 f, r3 31 40 f, t 46 55 f, given 60 60 s",
    "SCALE": "row 6 6 i, r1 11 20 f, r2 21 30 f, r3 31 40 f, t 46 55 f",
    "ORIGX": "row 6 6 i, r1 11 20 f, r2 21 30 f, r3 31 40 f, t 46 55 f",
    "CONECT": "serial 7 11 h, bonded_1 12 16 h, bonded_2 17 21 h, bonded_3 22 26 h, bonded_4 27 31 h",
    "TER": "serial 7 11 h, resname 18 20 s, chain 21 22 s, seqnum 23 26 h, icode 27 27 s",
}
_NUMBERED = ("MTRIX", "SCALE", "ORIGX")


def _fields(kind: str, line: str | Column = "line") -> list[Column]:
    padded = F.rpad(line, 80, " ")

    def field(first: str, last: str, of: str) -> Column:
        text = F.trim(F.substring(padded, int(first), int(last) - int(first) + 1))
        if of == "h":
            return hybrid36_int(text, int(last) - int(first) + 1)
        return text if of == "s" else F.when(text != "", text).try_cast("int" if of == "i" else "double")

    return [field(*x).alias(n) for n, *x in (x.split() for x in LAYOUTS[kind].split(", "))]


def pdb_records(lines: DataFrame, kind: str) -> DataFrame:
    """The records of one kind in lines (path, line_no, line): path, line_no and the record's fields. Blank numbers are null, blank texts empty."""
    padded = F.rpad("line", 80, " ")
    name = F.substring(padded, 1, 5) == kind if kind in _NUMBERED else F.rtrim(F.substring(padded, 1, 6)) == kind
    return lines.where(name).select("path", "line_no", *_fields(kind))


def database_references(lines: DataFrame) -> DataFrame:
    """The records DBREF, and those of two lines, DBREF1 and DBREF2, which hold longer accession codes and numbers: path, line_no and the fields of DBREF."""
    short = pdb_records(lines, "DBREF")
    name = F.substring("line", 1, 6)
    at = F.col("line_no") - F.when(name == "DBREF2", 1).otherwise(0)
    of = lambda kind: F.max(F.when(name == kind, F.col("line"))).alias(kind)
    pairs = lines.where(name.isin("DBREF1", "DBREF2")).groupBy("path", at.alias("line_no")).agg(of("DBREF1"), of("DBREF2")).where("DBREF1 is not null")
    long = pairs.select("path", "line_no", *_fields("DBREF1", "DBREF1"), *_fields("DBREF2", F.coalesce("DBREF2", F.lit(""))))
    return short.unionByName(long.select(short.columns))


def with_aniso(atoms: DataFrame, anisou: DataFrame) -> DataFrame:
    """Atoms with the tensor (u11 to u23, square angstroms) of the ANISOU record of their file, model and serial number; null without one."""
    u = ("u11", "u22", "u33", "u12", "u13", "u23")
    keys = [k for k in ("path", "model", "serial") if k in anisou.columns and k in atoms.columns]
    return atoms.join(anisou.select(*keys, *((F.col(c) * 1e-4).alias(c) for c in u)), keys, "left")


def operations(records: DataFrame, given: bool | None = None) -> DataFrame:
    """Operations of MTRIX records, a row each: path, op_name, r11 ... r33, t1, t2, t3; given: only those whose copies are in the file, or are not."""
    rows = records if given is None else records.where((F.col("given") == "1") == F.lit(given))
    pick = lambda c, i: F.max(F.when(F.col("row") == i, F.col(c)))
    names = [(f"r{i}{k}", f"r{k}", i) for i in (1, 2, 3) for k in (1, 2, 3)] + [(f"t{i}", "t", i) for i in (1, 2, 3)]
    whole = rows.groupBy("path", F.col("number").cast("string").alias("op_name")).agg(F.count_distinct("row").alias("_n"), *(pick(c, i).alias(n) for n, c, i in names))
    return whole.where("_n = 3").drop("_n")


def sequences_of(seqres: DataFrame) -> DataFrame:
    """Residue names of every chain, in order: path, chain, names."""
    parts = seqres.groupBy("path", "chain").agg(F.sort_array(F.collect_list(F.struct("line", "line_no", "residues"))).alias("_l"))
    return parts.select("path", "chain", F.filter(F.split(F.array_join(F.transform("_l", lambda x: x["residues"]), " "), " +"), lambda w: w != "").alias("names"))


def bonded_pairs(conect: DataFrame) -> DataFrame:
    """Bonds that CONECT records list: path, a and b (serial numbers, a < b) and how often they do."""
    both = conect.select("path", F.col("serial").alias("_a"), F.explode(F.array(*(f"bonded_{i}" for i in (1, 2, 3, 4)))).alias("_b")).where("_b is not null")
    return both.groupBy("path", F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).agg(F.count("*").alias("n"))
