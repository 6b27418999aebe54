import numpy as np
import pytest
from pyspark.sql import functions as F

from braggframe.functions.cell import Cell
from braggframe.functions.symmetry import spacegroup
from braggframe.operators import alignment, chemistry, cif_query, grid, model, reflections, selection, spatial
from braggframe.sources import cif, structures
from braggframe.sources.binary import Ccp4Source, MtzSource, ccp4_bytes, mtz_bytes, read_xds, register

ATOM = "model int, chain string, seqnum int, icode string, resname string, atom string, altloc string, element string, occ double, b_iso double, serial int, group_pdb string, entity_type string"


@pytest.fixture(scope="module")
def atoms(spark):
    rows = [
        (1, "A", 1, "", "ALA", "CA", "", "C", 1.0, 10.0, 1, "ATOM", "polymer"), (1, "A", 1, "", "ALA", "N", "", "N", 1.0, 20.0, 2, "ATOM", "polymer"), (1, "A", 2, "A", "GLY", "CA", "A", "C", 0.5, 60.0, 3, "ATOM", "polymer"),
        (1, "B", 5, "", "HOH", "O", "", "O", 1.0, 30.0, 4, "HETATM", "water"), (2, "A", 1, "", "ALA", "H", "", "H", 1.0, 5.0, 5, "ATOM", "polymer"), (1, "B", 7, "", "ZN", "ZN", "", "Zn", 1.0, 15.0, 6, "HETATM", "non-polymer"),
    ]
    return spark.createDataFrame(rows, ATOM).cache()


CIDS = {
    "*": [1, 2, 3, 4, 5, 6], "/1": [1, 2, 3, 4, 6], "A": [1, 2, 3, 5], "//A/1": [1, 2, 5], "/1/A/1-2": [1, 2], "1-2.A": [1, 2, 3, 5], "(ALA)": [1, 2, 5], "(!ALA)": [3, 4, 6], "/1//(GLY)/CA[C]:A": [3],
    "[metals]": [6], "[!H,C]": [2, 4, 6], "*;q<1": [3], "*;b>15": [2, 3, 4], "*;polymer": [1, 2, 3, 5], "*;solvent": [4], "A,B/5-": None, "//B//ZN": [6], "CA:": [1],
}


@pytest.mark.parametrize("text", CIDS)
def test_cid(atoms, text):
    if CIDS[text] is None:
        with pytest.raises(ValueError):
            selection.cid(text)
    else:
        assert [r.serial for r in atoms.where(selection.cid(text)).orderBy("serial").collect()] == CIDS[text]


PYMOL = {"all": [1, 2, 3, 4, 5, 6], "chain A and name CA": [1, 3], "resn ALA+GLY and not hydrogens": [1, 2, 3], "b > 15 and b <= 30 or elem Zn": [2, 4, 6], "not (polymer or water)": [6], "resi 1-2 & backbone": [1, 2, 3], "hetatm": [4, 6], "n. CA and c. A": [1, 3], "sidechain": [6], "index 2+4": [2, 4], "q != 1": [3]}


@pytest.mark.parametrize("text", PYMOL)
def test_pymol(atoms, text):
    assert [r.serial for r in atoms.where(selection.pymol(text)).orderBy("serial").collect()] == PYMOL[text]


def test_pymol_errors():
    for bad in ("chain", "(all", "all all", "colour red"):
        with pytest.raises(ValueError):
            selection.pymol(bad)


def test_merging_against_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(int(h), 0, 1, 1, float(v), float(s), int(h) % 2) for h, v, s in zip(rng.integers(0, 9, 60), rng.normal(50, 9, 60), rng.uniform(1, 4, 60), strict=True)]
    df = spark.createDataFrame([*rows, (1, 0, 1, 1, None, 1.0, 1), (1, 0, 1, 1, 5.0, 0.0, 1)], "h int, k int, l int, isign int, value double, sigma double, shell int")
    keys = ["h", "k", "l", "isign"]
    got = {r.h: r for r in reflections.merged(df, keys).collect()}
    for h in {r[0] for r in rows}:
        v, s = np.array([r[4] for r in rows if r[0] == h]), np.array([r[5] for r in rows if r[0] == h])
        assert got[h].value == pytest.approx((v / s**2).sum() / (1 / s**2).sum()) and got[h].sigma == pytest.approx((1 / s**2).sum() ** -0.5) and got[h].nobs == len(v)
    stats = {r.shell: r for r in reflections.merging_statistics(reflections.merging_sums(df, keys, "shell", "U")).collect()}
    for shell in (0, 1):
        dev = den = 0.0
        for h in {r[0] for r in rows if r[6] == shell}:
            v = np.array([r[4] for r in rows if r[0] == h])
            if len(v) > 1:
                dev, den = dev + np.abs(v - v.mean()).sum(), den + v.sum()
        assert stats[shell].r_merge == pytest.approx(dev / den)
        assert stats[shell].all_refl == sum(r[6] == shell for r in rows)


def test_expansion_keeps_one_of_friedel_mates(spark):
    df = spark.createDataFrame([(1, 2, 3, 10.0), (0, 2, 0, 20.0)], "h int, k int, l int, phi double")
    e = reflections.expanded_to_p1(df, spacegroup("P 21 21 21"), "phi")
    assert e.count() == 5
    assert e.where("h = 1 and k = 2 and l = 3").first().phi == pytest.approx(10.0)


def test_unique_reflections_cover_the_sphere(spark):
    cell, g = Cell(20, 20, 30), spacegroup("P 43 21 2")
    unique = reflections.all_reflections(spark, cell, g, 4.0)
    everything = reflections.all_reflections(spark, cell, g, 4.0, unique=False).where(~g.is_absent(F.col("h"), F.col("k"), F.col("l")))
    mapped = everything.select(g.to_asu(F.col("h"), F.col("k"), F.col("l")).alias("a")).select("a.h", "a.k", "a.l").distinct()
    assert mapped.exceptAll(unique).count() == 0 and unique.exceptAll(mapped).count() == 0


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(2)
    p = rng.uniform(-5, 5, (120, 3))
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "serial int, x double, y double, z double")
    got = {(r.serial, r.serial_2) for r in spatial.neighbours(df, df, 1.7).where("serial < serial_2").collect()}
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if ((p[i] - p[j]) ** 2).sum() < 1.7**2}
    assert got == want


def test_crystal_neighbours_against_brute_force(spark):
    cell, g, rng = Cell(9, 10, 11, 90, 100, 90), spacegroup("P 1 21 1"), np.random.default_rng(3)
    f = rng.uniform(-1, 2, (12, 3))
    x = f @ cell.orth.T
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "serial int, x double, y double, z double")
    pairs = spatial.crystal_neighbours(df, cell, g, 3.0)
    got = {}
    for r in pairs.collect():
        got[r.serial, r.serial_2] = got.get((r.serial, r.serial_2), 0) + 1
    want: dict = {}
    for i in range(12):
        for j in range(12):
            for o in g.ops:
                y = f[j] @ (np.array(o.rot).T / 24) + np.array(o.tran) / 24
                for s in np.ndindex(7, 7, 7):
                    base = f[i] - np.floor(f[i])
                    d = np.linalg.norm(cell.orth @ (y - np.floor(y) + np.array(s) - 3 - base))
                    if d < 3 and not (i == j and d < 1e-6):
                        want[i, j] = want.get((i, j), 0) + 1
    assert got == want


def test_torsions(spark):
    rows = [(1, "A", 1, i, "", "GLY", n, *map(float, xyz)) for i, res in enumerate([((0, 0, 0), (1.5, 0, 0), (2, 1.4, 0), (1.3, 2.4, 0)), ((3.3, 1.5, 0), (4, 2.7, 0.3), (5.4, 2.6, 0.1), (6, 1.6, 0)), ((6, 3.7, 0), (7.4, 3.8, 0.4), (8, 5, 0), (8, 6, 0))]) for n, xyz in zip(("N", "CA", "C", "O"), res, strict=True)]
    df = spark.createDataFrame([(m, c, i, i, ic, rn, n, 0.0 + x, y, z) for m, c, _, i, ic, rn, n, x, y, z in rows], "model int, chain string, res_ord int, seqnum int, icode string, resname string, atom string, x double, y double, z double").withColumn("atom_ord", F.monotonically_increasing_id())
    t = model.torsions(model.backbone(df)).orderBy("res_ord").collect()
    assert t[0].phi is None and t[2].psi is None and t[1].phi is not None and t[1].psi is not None and abs(t[0].omega) > 2


def test_alignment():
    assert alignment.align("AACGT", "AACGT") == (5, "5M")
    score, cigar = alignment.align("AAACCC", "AAAGGCCC", gap_open=-2, gap_extend=-1)
    assert (score, cigar) == (2, "3M2D3M")
    assert alignment.align("", "AB")[1] == "2D" and alignment.align("AB", "")[1] == "2I"


def test_superposition(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(10, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    rmsd, rot, tran = alignment.superpose(a @ q.T + 3, a)
    assert rmsd == pytest.approx(0, abs=1e-6) and rot == pytest.approx(q) and tran == pytest.approx([3, 3, 3])


CIF = """# a file
data_one
_cell.length_a 10.5(3)
_name 'it''s a name'
_note
;first
second
;
loop_
_atom.id
_atom.x
1 "a b"
2 ?
save_frame
_in.side x
save_
data_two
_cell.length_a .
"""


def test_cif(spark, tmp_path):
    (tmp_path / "a.cif").write_text(CIF)
    (tmp_path / "b.cif").write_text("data_x\nloop_\n_a\n_b\n1 2 3\n")
    items = cif.read_cif(spark, str(tmp_path)).cache()
    bad = cif.validated(items).where("not ok").collect()
    assert len(bad) == 1 and bad[0].line == 2 and bad[0].path.endswith("b.cif")
    assert cif_query.find_value(items, "_CELL.length_A").count() == 2
    t = cif_query.find_table(items, "_atom.", ["id", "?y", "x"]).orderBy("row_idx").collect()
    assert [(r["_atom.id"], r["_atom.y"], r["_atom.x"]) for r in t] == [("1", None, '"a b"'), ("2", None, "?")]
    assert cif_query.find_table(items, "_", ["atom.id", "cell.length_a"]).count() == 0
    assert [r.value for r in cif_query.grep(items, "_note").collect()] == ["first\nsecond"]
    assert cif_query.grep(items, "_atom.x", raw=True).count() == 2 and cif_query.grep(items, "_atom.x").count() == 1
    stats = {r.tag: r for r in cif_query.tag_statistics(items).collect()}
    assert stats["_atom.id"].n_number == 2 and stats["_note"].n_text == 1
    again = cif.to_cif_text(items.where("path like '%a.cif'")).where("block = 'one'").first().text
    back = [r[6:10] for r in cif.parse_cif(again) if r[9] is not None]
    assert back == [r[6:10] for r in cif.parse_cif(CIF) if r[9] is not None and r[1] == "one" and r[2] is None]
    assert '"_atom"' not in cif.to_mmjson(items).where("block = 'one'").first().json
    rules = spark.createDataFrame([("_cell.length_a", None, None, 20.0, 30.0, True), ("_atom.id", "[0-9]+", ["1"], None, None, False), ("_atom.z", None, None, None, None, True)], "tag string, type_regex string, enumeration array<string>, low double, high double, mandatory boolean")
    found = {(r.tag, r.problem) for r in cif_query.check_values(items, rules).collect()}
    assert ("_cell.length_a", "range") in found and ("_atom.id", "enumeration") in found and ("_note", "unknown tag") in found
    assert {r.tag for r in cif_query.check_mandatory(items.where("block = 'one'"), rules).collect()} == {"_atom.z"}


PDB = """CRYST1   30.000   40.000   50.000  90.00  90.00  90.00 P 21 21 21
ATOM      1  N   ALA A   1      11.104   6.134  -6.504  1.00 12.50           N
ATOM      2  CA AALA A   1      11.639   6.071  -5.147  0.50 13.00           C1+
TER
HETATM    3 ZN    ZN A   2       1.000   2.000   3.000  1.00 20.00          ZN
"""


def test_pdb(spark, tmp_path):
    (tmp_path / "x.pdb").write_text(PDB)
    a = structures.read_pdb(spark, str(tmp_path)).orderBy("atom_ord")
    rows = a.collect()
    assert [(r.atom, r.element, r.altloc, r.charge, r.x, r.occ, r.res_ord) for r in rows] == [("N", "N", "", 0, 11.104, 1.0, 1), ("CA", "C", "A", 1, 11.639, 0.5, 1), ("ZN", "Zn", "", 0, 1.0, 1.0, 2)]
    assert structures.read_pdb_cell(spark, str(tmp_path)).first().spacegroup == "P 21 21 21"
    lines = [r.line.rstrip() for r in structures.pdb_lines(a).collect()]
    assert lines == [x.rstrip() for x in PDB.splitlines() if x.startswith(("ATOM", "HETATM"))]


def test_fasta(spark, tmp_path):
    (tmp_path / "s.fa").write_text(">one\nACD\nEF*\n>P1;two\nthe second\nGH(MSE)\nI*\n")
    rows = structures.read_fasta(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.header, r.seq) for r in rows] == [("one", "ACDEF"), ("P1;two the second", "GH(MSE)I")]


def test_mtz_and_map(spark, tmp_path):
    register(spark)
    rows = np.array([[2, 0, 1, 5.5], [1, 0, 0, np.nan], [1, -1, 3, 2.25]])
    (tmp_path / "x.mtz").write_bytes(mtz_bytes([("H", "H"), ("K", "H"), ("L", "H"), ("F", "F")], rows, [10, 20, 30, 90, 90, 90], "P 1", 1, ["X, Y, Z"]))
    got = spark.read.format("mtz").load(str(tmp_path / "x.mtz")).orderBy("row").collect()
    assert [(r.h, r.k, r.l, r.F) for r in got] == [(1, -1, 3, 2.25), (1, 0, 0, None), (2, 0, 1, 5.5)]
    g = np.arange(24.0).reshape(2, 3, 4)
    (tmp_path / "x.ccp4").write_bytes(ccp4_bytes(g, [10, 20, 30, 90, 90, 90]))
    got = spark.read.format("ccp4").load(str(tmp_path / "x.ccp4")).collect()
    assert len(got) == 24 and all(r.value == g[r.u, r.v, r.w] for r in got)
    assert MtzSource.name() == "mtz" and Ccp4Source.name() == "ccp4"


def test_xds(spark, tmp_path):
    (tmp_path / "x.hkl").write_text("!FORMAT=XDS_ASCII MERGE=FALSE\n!SPACE_GROUP_NUMBER= 19\n 1 2 3 10.5 0.5 7 8 9\n-1 0 2 3.0 -1.0 1 2 3\n!END_OF_DATA\n")
    head, data = read_xds(spark, str(tmp_path))
    assert {(r.key, r.value) for r in head.collect()} >= {("MERGE", "FALSE"), ("SPACE_GROUP_NUMBER", "19")}
    assert [tuple(r[1:6]) for r in data.orderBy("h").collect()] == [(-1, 0, 2, 3.0, -1.0), (1, 2, 3, 10.5, 0.5)]


def test_fourier_round_trip(spark):
    size, cell = (8, 6, 4), Cell(8, 6, 4)
    rng = np.random.default_rng(5)
    rho = rng.normal(size=size)
    rows = [(1, int(u), int(v), int(w), float(rho[u, v, w])) for u, v, w in np.ndindex(size)]
    g = spark.createDataFrame(rows, "m int, u int, v int, w int, value double")
    c = grid.coefficients_from_map(g, ["m"], size, cell.volume)
    full = grid.reciprocal_points(c.drop("m"), spacegroup("P 1"), "f", "phi").withColumn("m", F.lit(1)).where("abs(h) < 4 and abs(k) < 3 and abs(l) < 2")
    back = grid.map_from_coefficients(full, ["m"], size, cell.volume)
    j = g.join(back.withColumnRenamed("value", "v2"), ["m", "u", "v", "w"])
    assert j.agg(F.corr("value", "v2")).first()[0] > 0.6  # the planes at the Nyquist limit are left out


def test_islands_cross_the_edge(spark):
    pts = [(0, 0, 0, 9.0), (3, 0, 0, 8.0), (1, 0, 0, 7.0), (2, 2, 2, 9.0)]
    g = spark.createDataFrame([(*p[:3], p[3]) for p in pts], "u int, v int, w int, value double")
    got = {(r.u, r.v, r.w): r.island for r in grid.islands(g, 1.0, (4, 4, 4)).collect()}
    assert got[0, 0, 0] == got[3, 0, 0] == got[1, 0, 0] != got[2, 2, 2]


def test_solvent_mask(spark):
    a = spark.createDataFrame([(5.0, 5.0, 5.0, 2.0)], "x double, y double, z double, radius double")
    n = grid.solvent_mask(a, Cell(10, 10, 10), (20, 20, 20)).count()
    assert 4 / 3 * np.pi * 1.5**3 * 8 < n < 4 / 3 * np.pi * 3**3 * 8


def test_chemistry(spark):
    assert chemistry.rings_of([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]) == [("a", "b", "c")]
    benzene = {(f"C{i}", f"C{(i + 1) % 6}"): "AROM" for i in range(6)}
    assert len(chemistry.match_pattern({f"C{i}": "C" for i in range(6)}, benzene, "c1ccccc1")) == 12
    acid = ({"C": "C", "O1": "O", "O2": "O", "H": "H"}, {("C", "O1"): "DOUB", ("C", "O2"): "SING", ("O2", "H"): "SING"})
    assert chemistry.match_pattern(*acid, "C(=O)[OH]") == [("C", "O1", "O2")]
    df = spark.createDataFrame([("C10 H16 N5",), ("H2 O",)], "f string")
    assert [round(r[0], 3) for r in df.select(chemistry.formula_weight(F.col("f"))).collect()] == [206.268, 18.015]


def test_restraints(spark):
    r = spark.createDataFrame([(1, "bond", "A", "B", None, None, 1.4, 0.1, None), (1, "angle", "A", "B", "C", None, 95.0, 1.0, None), (1, "torsion", "A", "B", "C", "D", 181.0, 5.0, 1)], "res_id int, kind string, atom1 string, atom2 string, atom3 string, atom4 string, ideal double, esd double, period int")
    a = spark.createDataFrame([(1, "A", 1.5, 0.0, 0.0), (1, "B", 0.0, 0.0, 0.0), (1, "C", 0.0, 1.0, 0.0), (1, "D", -1.0, 1.0, 0.0)], "res_id int, name string, x double, y double, z double")
    z = {x.kind: x.rmsz for x in model.rmsz(chemistry.restraint_values(r, a), ["kind"]).collect()}
    assert z == {"bond": pytest.approx(1.0), "angle": pytest.approx(5.0), "torsion": pytest.approx(0.2)}


def test_exact_ranks_keep_other_columns(spark):
    """Ranks are those of the whole table whatever else it holds: without gaps, and without two rows of one rank."""
    n = 60_000
    df = spark.range(n).select(((F.col("id") * 7919) % n).alias("x"), F.col("id").alias("other"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    got = reflections.exact_ranks(df, "x")
    assert got.where("_rank = x").count() == n and got.columns == ["x", "other", "text", "_rank"]


def test_no_angle_without_an_atom(spark):
    from braggframe.functions.geometry import angle

    v = lambda *x: tuple(F.lit(y).cast("double") for y in x)
    row = spark.range(1).select(angle(v(1, 0, 0), v(0, 0, 0), v(0, 2, 0)).alias("a"), angle(v(1, 0, 0), v(0, 0, 0), v(None, 2, 0)).alias("b")).first()
    assert abs(row.a - 1.5707963) < 1e-6 and row.b is None
