import pytest
from pyspark.sql import functions as F

from braggframe.functions.cell import Cell
from braggframe.functions.symmetry import spacegroup
from braggframe.operators import editing, reflections
from braggframe.sources import cif, structures
from braggframe.streaming import merging

TEXT = "data_a\nloop_\n_t.id\n_t.v\n3 x\n1 y\n20 z\n_other 5\n"


@pytest.fixture
def items(spark, tmp_path):
    (tmp_path / "a.cif").write_text(TEXT)
    return cif.read_cif(spark, str(tmp_path))


def rows(items):
    out: dict = {}
    for r in items.where("category = 't'").collect():
        out.setdefault(r.row_idx, {})[r.tag] = r.value_raw
    return [tuple(v for _, v in sorted(out[k].items())) for k in sorted(out)]


def test_edits_of_loops(items):
    assert rows(editing.added_row(items, "_t.", {"id": "9"})) == [("3", "x"), ("1", "y"), ("20", "z"), ("9", "?")]
    assert rows(editing.added_row(items, "_t.", {"ID": "9", "v": "w"}, 1)) == [("3", "x"), ("9", "w"), ("1", "y"), ("20", "z")]
    assert rows(editing.without_rows(items, "_t.", 0, 2)) == [("20", "z")]
    assert rows(editing.moved_row(items, "_t.", 0, 2)) == [("1", "y"), ("20", "z"), ("3", "x")]
    assert rows(editing.moved_row(items, "_t.", 2, 0)) == [("20", "z"), ("3", "x"), ("1", "y")]
    assert rows(editing.added_column(items, "_t.", "w", "0"))[0] == ("3", "x", "0")
    assert rows(editing.sorted_loop(items, "_t.", ["id"])) == [("1", "y"), ("3", "x"), ("20", "z")]


def test_label_numbers(spark):
    df = spark.createDataFrame([("A", "1I2M1D2M")], "chain string, cigar string")
    assert sorted(tuple(r) for r in editing.label_numbers(df).collect()) == [("A", 0, 2), ("A", 1, 3), ("A", 3, 4), ("A", 4, 5)]


def test_original_indices(spark):
    g = spacegroup("P 43 21 2")
    df = spark.createDataFrame([(h, k, l) for h in range(-2, 3) for k in range(-2, 3) for l in (-1, 0, 4)], "h0 int, k0 int, l0 int").withColumns({"h": F.col("h0"), "k": F.col("k0"), "l": F.col("l0")})
    back = editing.original_indices(reflections.in_asu(df, g), g)
    assert back.where("h <> h0 or k <> k0 or l <> l0").count() == 0


def test_addresses_and_ranges(spark):
    atoms = spark.createDataFrame([("A", 1, "", "ALA", "CA", "B", 0.5, 0.0, 0.0), ("A", 9, "", "ALA", "CB", "", 9.5, 0.0, 0.0)], "chain string, seqnum int, icode string, resname string, atom string, altloc string, x double, y double, z double")
    a = spark.createDataFrame([("A", 1, "", "ALA", "CA", "", "one"), ("A", 1, "", "ALA", "CA", "C", "two")], "chain string, seqnum int, icode string, resname string, atom string, altloc string, tag string")
    assert [r.tag for r in editing.at_addresses(atoms, a).collect()] == ["one"]
    c = spark.createDataFrame([("c1", "A", 1, "CA", "A", 9, "CB")], "conn_id string, chain_1 string, seqnum_1 int, atom_1 string, chain_2 string, seqnum_2 int, atom_2 string")
    assert editing.connection_lengths(c, atoms, Cell(10, 10, 10), spacegroup("P 1")).first().dist == pytest.approx(1.0)
    t = spark.createDataFrame([("A", 5, 10, 2)], "chain string, first int, last int, tls_group int")
    assert {r.seqnum: r.tls_group for r in editing.tls_groups(atoms, t).collect()} == {1: None, 9: 2}
    p = spark.createDataFrame([("A", 1, 1), ("A", 1, 2), ("A", 2, 1), ("A", 2, 3)], "chain string, part int, seqnum int")
    assert sorted(r.seqnum for r in editing.merged_chain_parts(p, 5).collect()) == [1, 2, 8, 10]
    al = spark.createDataFrame([("ALA", "CA", "CX"), ("ALA", "CB", "CY")], "resname string, old string, new string")
    assert {r.atom for r in editing.renamed_by_vote(atoms, al).collect()} == {"CX", "CY"}


def test_grid_sizes():
    assert editing.good_size(7) == 8 and editing.good_size(31, 6) == 36
    n = editing.map_size(Cell(30, 30, 70), spacegroup("P 43 21 2"), 2.0)
    assert n[0] == n[1] and n[2] % 4 == 0 and all(x % 2 == 0 for x in n) and n[0] >= 45


PDB = """REMARK   2 RESOLUTION.    1.80 ANGSTROMS.
REMARK   3   R VALUE            (WORKING SET) : 0.187
REMARK   3   FREE R VALUE                     : 0.221
REMARK 290       1555   X,Y,Z
REMARK 290       2555   -X,Y+1/2,-Z
HELIX    1   1 ALA A    2  GLY A    9  1                                   8
SHEET    1   A 2 VAL A  11  THR A  15  0
SEQRES   1 A    3  ALA GLY
SEQRES   2 A    3  VAL
"""


def test_pdb_records(spark, tmp_path):
    (tmp_path / "x.pdb").write_text(PDB)
    m = structures.remark_metadata(spark, str(tmp_path)).first()
    assert (m.resolution, m.r_work, m.r_free) == (1.8, 0.187, 0.221)
    assert [r.triplet for r in structures.remark_290(spark, str(tmp_path)).orderBy("number").collect()] == ["X,Y,Z", "-X,Y+1/2,-Z"]
    assert {tuple(r)[1:] for r in structures.secondary_ranges(spark, str(tmp_path)).collect()} == {("A", 2, 9, "H"), ("A", 11, 15, "E")}
    assert structures.sequence_records(spark, str(tmp_path)).first().names == ["ALA", "GLY", "VAL"]
    df = spark.createDataFrame([("a/B.PDB.gz",), ("x.cif",), ("y.js",), ("z",)], "p string")
    assert [r[0] for r in df.select(structures.coordinate_format(F.col("p"))).collect()] == ["pdb", "mmcif", "mmjson", "unknown"]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.cif").write_text(TEXT)
    got = merging.run_once(merging.arriving_cif(spark, str(tmp_path / "in")), "arrived", "append")
    assert got.where("tag = '_t.id'").count() == 3
    df = spark.createDataFrame([(1, 10.0, 1.0), (1, 20.0, 2.0), (2, 5.0, 0.5)], "h int, value double, sigma double")
    df.write.parquet(f"{tmp_path}/obs")
    merged = merging.run_once(merging.merge_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/obs"), ["h"]), "merged_obs")
    batch = {r.h: r for r in reflections.merged(df, ["h"]).collect()}
    for r in merged.collect():
        assert r.value == pytest.approx(batch[r.h].value) and r.sigma == pytest.approx(batch[r.h].sigma) and r.nobs == batch[r.h].nobs
