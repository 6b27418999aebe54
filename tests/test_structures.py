import numpy as np
import pytest
from pyspark.sql import functions as F

from braggframe.functions import numeric
from braggframe.functions.cell import Cell
from braggframe.functions.symmetry import parse_triplet, spacegroup
from braggframe.operators import lattice, model, scaling, spatial, structure
from braggframe.plans import composite
from braggframe.sources import binary, cif, crystallography


def test_special_functions(spark):
    x = np.array([0.0, 0.1, 1.0, 3.7, 3.8, 10.0, 80.0, -2.0])
    i0 = np.i0(x[:6])
    rows = spark.createDataFrame([(float(v),) for v in x], "x double").select("x", numeric.log_bessel_i0(F.col("x")).alias("l"), numeric.bessel_i1_over_i0(F.col("x")).alias("r"), numeric.log_cosh(F.col("x")).alias("c")).collect()
    assert [r.l for r in rows[:6]] == pytest.approx(np.log(i0), abs=1e-6)
    grid = np.linspace(0, np.pi, 20001)
    for r in rows:
        e = np.exp(r.x * np.cos(grid) - abs(r.x))
        assert r.r == pytest.approx(np.trapezoid(e * np.cos(grid), grid) / np.trapezoid(e, grid), abs=2e-6)
        assert r.c == pytest.approx(np.logaddexp(r.x, -r.x) - np.log(2), abs=1e-12)


def test_tls(spark):
    t = numeric.tls_tensor([F.lit(v) for v in (0.1, 0.2, 0.3, 0.01, 0.02, 0.03)], [F.lit(v) for v in (1.0, 2.0, 3.0, 0.1, 0.2, 0.3)], [[F.lit(0.0)] * 3 for _ in range(3)], F.lit(1.0), F.lit(2.0), F.lit(3.0))
    r = np.pi / 180
    L = np.array([[1.0, 0.1, 0.2], [0.1, 2.0, 0.3], [0.2, 0.3, 3.0]]) * r * r
    A = np.array([[0, 3.0, -2.0], [-3.0, 0, 1.0], [2.0, -1.0, 0]])
    U = np.array([[0.1, 0.01, 0.02], [0.01, 0.2, 0.03], [0.02, 0.03, 0.3]]) + A @ L @ A.T
    got = spark.range(1).select(*t).first()
    assert list(got) == pytest.approx([U[0, 0], U[1, 1], U[2, 2], U[0, 1], U[0, 2], U[1, 2]])


def test_lattice():
    assert len(lattice.lattice_symmetry(Cell(5, 5, 5)).ops) == 24
    assert len(lattice.lattice_symmetry(Cell(5, 5, 7)).ops) == 8
    assert len(lattice.lattice_symmetry(Cell(5, 5, 7, 90, 90, 120)).ops) == 12
    assert len(lattice.lattice_symmetry(Cell(5, 6, 7)).ops) == 4
    assert len(lattice.lattice_symmetry(Cell(5, 6, 7, 81, 95, 103)).ops) == 1
    assert len(lattice.twin_laws(Cell(5, 5, 7), spacegroup("P 4"))) == 1 and lattice.twin_laws(Cell(5, 6, 7), spacegroup("P 2 2 2")) == []
    assert lattice.buerger(Cell.from_metric(np.array([[1, 2, 0], [0, 1, 3], [0, 0, 1]]).T @ Cell(5, 6, 7).metric @ np.array([[1, 2, 0], [0, 1, 3], [0, 0, 1]]))).volume == pytest.approx(210)
    assert (lattice.selling(Cell(5, 6, 7, 70, 80, 65)) <= 1e-6).all()
    assert lattice.compatible(Cell(5, 5, 7), spacegroup("P 4")) and not lattice.compatible(Cell(5, 6, 7), spacegroup("P 4"))
    assert lattice.changed_basis(Cell(5, 6, 7), parse_triplet("y,z,x")).volume == pytest.approx(210)


def test_scaling(spark):
    rng = np.random.default_rng(1)
    n = 400
    fc, fm, s = rng.normal(size=(n, 2)) * 50, rng.normal(size=(n, 2)) * 20, rng.uniform(0.001, 0.06, n)
    total = fc + 0.4 * np.exp(-50 * s)[:, None] * fm
    fo = 2.5 * np.exp(-12 * s) * np.hypot(*total.T)
    df = spark.createDataFrame([(*map(float, a), *map(float, b), float(x), float(f)) for a, b, x, f in zip(fc, fm, s, fo, strict=True)], "fc_re double, fc_im double, fm_re double, fm_im double, s double, fo double")
    got = scaling.bulk_solvent_scale(df, "fo", F.col("s"), start=(1.0, 0.0, 0.3, 40.0), rounds=40)
    assert got["k"] == pytest.approx(2.5, rel=1e-3) and got["b"] == pytest.approx(12, rel=1e-2) and got["k_sol"] == pytest.approx(0.4, rel=1e-2)
    plain = df.withColumn("f", F.sqrt(F.col("fc_re") ** 2 + F.col("fc_im") ** 2) + 1).withColumn("o", F.col("f") * 3 * F.exp(-0.25 * 8 * F.col("s")))
    assert scaling.anisotropic_scale(plain, "o", "f", {"b11": F.col("s")}) == pytest.approx({"k": 3.0, "b11": 8.0})


def backbone(spark, n=12):
    """A straight helix of backbone atoms."""
    rows = []
    for i in range(n):
        for j, (name, r, a, z) in enumerate((("N", 1.55, 0, 0), ("CA", 2.28, 28, 0.9), ("C", 1.68, 55, 2.0), ("O", 2.0, 60, 3.2))):
            t = np.radians(100 * i + a)
            rows.append((1, "A", i, i, "", "ALA", name, 4 * i + j, float(r * np.cos(t)), float(r * np.sin(t)), 1.5 * i + z))
    return spark.createDataFrame(rows, "model int, chain string, res_ord int, seqnum int, icode string, resname string, atom string, atom_ord int, x double, y double, z double")


def test_hydrogen_bonds_and_torsions(spark):
    atoms = backbone(spark)
    residues = structure.with_amide_hydrogens(model.backbone(atoms)).withColumn("id", F.col("res_ord"))
    assert residues.where("h is null").count() == 1
    got = structure.hydrogen_bonds(residues).collect()
    assert got and max(r["rank"] for r in got) <= 2 and all(-9.9 <= r.energy < 0 for r in got)
    assert composite.ramachandran(atoms).count() == 10


def test_moving_superposition(spark):
    rng = np.random.default_rng(2)
    a = np.cumsum(rng.normal(size=(20, 3)), axis=0)
    b = a.copy()
    b[10:] += [5, 0, 0]
    df = spark.createDataFrame([("A", i, *map(float, p), *map(float, q)) for i, (p, q) in enumerate(zip(a, b, strict=True))], "chain string, ord long, x double, y double, z double, x_2 double, y_2 double, z_2 double")
    rows = {r.ord: r for r in structure.moving_superposition(df, 6.0).collect()}
    assert rows[0].rmsd == pytest.approx(0, abs=1e-6) and max(r.rmsd for r in rows.values() if r.rmsd is not None) > 0.3


def test_numbering_and_names(spark):
    known = spark.createDataFrame([("A", 1, 11), ("A", 2, 12), ("A", 5, 20)], "chain string, label_seq int, seqnum int")
    asked = spark.createDataFrame([("A", 1), ("A", 3), ("A", 6), ("A", 0)], "chain string, label_seq int")
    assert {r.label_seq: r.seqnum for r in structure.label_to_auth(known, asked).collect()} == {1: 11, 3: 13, 6: 21, 0: 10}
    names = spark.createDataFrame([("ABCDE",), ("ALA",), ("ABCDF",)], "n string")
    assert [tuple(r) for r in structure.short_names(names, "n").orderBy("n").collect()] == [("ABCDE", "~00"), ("ABCDF", "~01")]


def test_deuterium_round_trip(spark):
    rows = [(1, "A", 1, "N", "N", 1.0, "", 1), (1, "A", 1, "H", "H", 0.25, "A", 2), (1, "A", 1, "D", "D", 0.75, "D", 3)]
    df = spark.createDataFrame(rows, "model int, chain string, res_ord int, atom string, element string, occ double, altloc string, atom_ord int")
    one = structure.deuterium_as_fraction(df)
    assert one.count() == 2 and one.where("atom = 'H'").first().d_fraction == 0.75
    back = structure.deuterium_as_altlocs(one).select("atom", "element", "occ", "altloc").collect()
    assert {tuple(r) for r in back} == {("N", "N", 1.0, ""), ("H", "H", 0.25, "A"), ("D", "D", 0.75, "D")}


def test_copies(spark):
    a = spark.createDataFrame([("A", "CA", "C", "", "ALA", 1, 10.0, 0.5, 1.0, 2.0, 3.0), ("A", "CB", "C", "", "ALA", 1, 10.0, 0.5, 4.0, 5.0, 6.0)], "chain string, atom string, element string, altloc string, resname string, seqnum int, b_iso double, occ double, x double, y double, z double")
    ops = spark.createDataFrame([("A", "-2", -1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, 1.0, 2.0, 4.0, 0.05)], "chain string, op_name string, r11 double, r12 double, r13 double, r21 double, r22 double, r23 double, r31 double, r32 double, r33 double, t1 double, t2 double, t3 double")
    copied = spatial.copied_by(a, ops)
    assert {r.chain for r in copied.collect()} == {"A-2"}
    both = a.unionByName(copied.select(a.columns))
    m = spatial.merged_copies(both, 0.2)
    assert m.count() == 3 and m.where("atom = 'CA'").first().occ == 1.0 and m.where("atom = 'CA'").first().z == pytest.approx(3.025)
    r = [F.col(f"r{i}{k}") for i in (1, 2, 3) for k in (1, 2, 3)]
    assert ops.select(structure.is_rotation(r)).first()[0]


def test_sites_on_special_positions(spark):
    sites = spark.createDataFrame([("Na", 0.0, 0.0, 0.0), ("C", 0.1, 0.2, 0.3)], "label string, fx double, fy double, fz double")
    got = structure.unit_cell_sites(sites, spacegroup("P -1"), Cell(10, 10, 10))
    assert {r.label: r["count"] for r in got.groupBy("label").count().collect()} == {"Na": 1, "C": 2}


SF = """data_r1
_cell.length_a 10
_cell.length_b 20
_cell.length_c 30
_cell.angle_alpha 90
_cell.angle_beta 90
_cell.angle_gamma 90
_symmetry.space_group_name_H-M 'P 21 21 21'
loop_
_refln.index_h
_refln.index_k
_refln.index_l
_refln.status
_refln.F_meas_au
_refln.F_meas_sigma_au
1 0 0 o 10.5(2) 0.5
0 2 0 f ? 1.0
data_r2
loop_
_refln.index_h
_refln.index_k
_refln.index_l
_refln.pdbx_F_plus
1 2 3 7
"""
COMP = """data_X
loop_
_chem_comp_atom.comp_id
_chem_comp_atom.atom_id
_chem_comp_atom.type_symbol
_chem_comp_atom.model_Cartn_x
_chem_comp_atom.model_Cartn_y
_chem_comp_atom.model_Cartn_z
X C1 C 0 0 0
X "O1'" O 1.2 0 0
loop_
_chem_comp_bond.comp_id
_chem_comp_bond.atom_id_1
_chem_comp_bond.atom_id_2
_chem_comp_bond.value_order
X C1 "O1'" DOUB
loop_
_entity_poly.entity_id
_entity_poly.type
1 polypeptide(L)
2 polyribonucleotide
loop_
_entity_poly_seq.entity_id
_entity_poly_seq.mon_id
1 ALA
1 ALA
1 GLY
2 A
"""
CORE = """data_s
loop_
_symmetry_equiv_pos_as_xyz
'x, y, z'
-x,-y,-z
loop_
_atom_site_label
_atom_site_fract_x
_atom_site_fract_y
_atom_site_fract_z
Na1 0 0 0
C2 0.1(1) 0.2 0.3
"""
DICT = """data_d
loop_
_item_type_list.code
_item_type_list.construct
int '[+-]?[0-9]+'
loop_
_item_linked.child_name
_item_linked.parent_name
'_a.x' '_b.x'
save_a.x
_item.name '_a.x'
_item.mandatory_code yes
_item_type.code int
_item_range.minimum 1
_item_range.maximum 5
save_
"""


def test_domain_tables(spark, tmp_path):
    for name, text in (("sf", SF), ("comp", COMP), ("core", CORE), ("dict", DICT)):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.cif").write_text(text)
    items = cif.read_cif(spark, str(tmp_path / "sf")).cache()
    r = {(x.h, x.k, x.l): x for x in crystallography.reflections(items).collect()}
    assert r[1, 0, 0].fp == 10.5 and r[0, 2, 0].fp is None and r[0, 2, 0].free_flag == 0 and r[1, 2, 3].f_plus == 7.0
    cells = crystallography.block_cells(items).orderBy("block_idx").collect()
    assert [c.length_b for c in cells] == [20.0, 20.0] and cells[1].spacegroup == "P 21 21 21"
    assert crystallography.block_with(items, "refln", ["pdbx_F_plus"]).first().block == "r2"
    again = crystallography.refln_items(crystallography.reflections(items).where("block = 'r1'").drop("path", "block_idx", "block"), "new")
    text = cif.to_cif_text(again).first().text
    assert text.startswith("data_new\nloop_\n_refln.index_h") and "0 2 0 f ?" in text
    comp = cif.read_cif(spark, str(tmp_path / "comp")).cache()
    atoms = crystallography.component_atoms(comp)
    assert {(a.name, a.element) for a in atoms.collect()} == {("C1", "C"), ("O1'", "O")} and crystallography.component_models(atoms).select("model").distinct().collect()[0].model == 2
    assert [tuple(b) for b in crystallography.component_bonds(comp).select("a", "b", "order").collect()] == [("C1", "O1'", "DOUB")]
    assert {(f.mon_id, f.n) for f in composite.residue_frequency(comp).collect()} == {("ALA", 2), ("GLY", 1)}
    core = cif.read_cif(spark, str(tmp_path / "core"))
    assert [(s.label, s.element, s.fx) for s in crystallography.small_molecule_sites(core).orderBy("row_idx").collect()] == [("Na1", "Na", 0.0), ("C2", "C", 0.1)]
    assert [o.triplet for o in crystallography.small_molecule_operations(core).orderBy("row_idx").collect()] == ["x,y,z", "-x,-y,-z"]
    d = cif.read_cif(spark, str(tmp_path / "dict")).cache()
    rule = crystallography.dictionary_rules(d).first()
    assert (rule.tag, rule.type_regex, rule.low, rule.high, rule.mandatory) == ("_a.x", "[+-]?[0-9]+", 1.0, 5.0, True)
    assert [tuple(p) for p in crystallography.dictionary_parents(d).collect()] == [("_a.x", "_b.x")]
    binary.register(spark)
    source = spark.read.format("cif").load(str(tmp_path / "sf"))
    assert source.drop("path").exceptAll(items.drop("path")).count() == 0 and source.count() == items.count()
    assert spark.read.format("cif").option("oneBlock", "true").load(str(tmp_path / "sf" / "sf.cif")).where("block = 'r2'").count() == 0
    mtz, labels = crystallography.mtz_columns(crystallography.reflections(items))
    assert labels == [("FreeR_flag", "I"), ("FP", "F"), ("SIGFP", "Q"), ("F(+)", "G")] and mtz.count() == 3
    assert crystallography.deposition_problems(crystallography.reflections(items)) == []
    assert {w.kind for w in crystallography.walk(spark, str(tmp_path)).collect()} == {"cif"}


def test_dsn6(spark, tmp_path):
    head = np.zeros(256, "<i2")
    head[0:3], head[3:6], head[6:9], head[15], head[16], head[18] = 0, 8, 8, 200, 50, 100
    value = np.arange(512, dtype=np.uint8).reshape(8, 8, 8)
    raw = value.ravel().reshape(-1, 2)[:, ::-1].ravel()
    (tmp_path / "m.dsn6").write_bytes(head.astype(">i2").tobytes() + raw.tobytes())
    rows = crystallography.read_dsn6(spark, str(tmp_path)).collect()
    assert len(rows) == 512 and all(r.value == pytest.approx((float(value[r.w, r.v, r.u]) - 50) / 2) for r in rows)


def test_interpolated_table(spark):
    t = spark.createDataFrame([("Fe", 1.0, 10.0), ("Fe", 2.0, 20.0)], "element string, e double, fp double")
    df = spark.createDataFrame([("Fe", 1.25), ("Fe", 2.5), ("Zn", 1.5)], "element string, e double")
    assert {(r.element, r.e): r.fp for r in numeric.interpolated_table(df, t, "element", "e", ["fp"]).collect()} == {("Fe", 1.25): 12.5, ("Fe", 2.5): None, ("Zn", 1.5): None}
