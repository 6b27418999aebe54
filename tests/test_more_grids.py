import numpy as np
import pytest
from pyspark.sql import functions as F

from braggframe import catalog
from braggframe.functions.cell import Cell
from braggframe.functions.symmetry import spacegroup
from braggframe.operators import grid, topology
from braggframe.sources.binary import full_cell_map, mtz_bytes, register, write_mtz, xds_observations

SIZE = (8, 8, 8)


def wave(spark):
    rows = [(u, v, w, float(np.cos(2 * np.pi * u / 8) + np.cos(2 * np.pi * v / 8) + np.cos(2 * np.pi * w / 8))) for u, v, w in np.ndindex(SIZE)]
    return spark.createDataFrame(rows, "u int, v int, w int, value double")


def test_interpolations(spark):
    g = wave(spark)
    p = spark.createDataFrame([(0.0, 0.0, 0.0), (0.26, 0.4, 0.93), (-0.1, 1.2, 0.5)], "fx double, fy double, fz double")
    true = lambda r: sum(np.cos(2 * np.pi * x) for x in (r.fx, r.fy, r.fz))
    for r in grid.tricubic(p, g, SIZE).collect():
        assert r.value == pytest.approx(true(r), abs=0.06)
    for r in grid.interpolated(p, g, SIZE).collect():
        assert r.value == pytest.approx(true(r), abs=0.25)
    assert grid.nearest_values(p, g, SIZE).where("fx = 0").first().value == pytest.approx(3.0)
    assert grid.resampled(g, SIZE, (4, 4, 4)).where("u = 2 and v = 2 and w = 2").first().value == pytest.approx(-3.0)
    assert grid.grid_correlation(g, g).first().cc == pytest.approx(1.0)


def test_isosurface_of_a_ball(spark):
    n = 16
    rows = [(u, v, w, -float(np.hypot(np.hypot(u - 8, v - 8), w - 8))) for u, v, w in np.ndindex((n, n, n))]
    g = spark.createDataFrame(rows, "u int, v int, w int, value double")
    area = 0.0
    for t in grid.isosurface(g, -5.0, (n, n, n)).collect():
        a, b, c = (np.array(x) * n for x in (t.p1, t.p2, t.p3))
        area += np.linalg.norm(np.cross(b - a, c - a)) / 2
        assert np.linalg.norm(a - 8) == pytest.approx(5, abs=0.2)
    assert area == pytest.approx(4 * np.pi * 25, rel=0.03)


def test_soft_edge(spark):
    mask = spark.createDataFrame([(4, 4, 4, 1.0)], "u int, v int, w int, value double")
    got = {(r.u, r.v, r.w): r.value for r in grid.soft_edge(mask, Cell(8, 8, 8), SIZE, 2.0).collect()}
    assert got[4, 4, 4] == pytest.approx(1.0) and got[5, 4, 4] == pytest.approx(0.5) and (7, 4, 4) not in got


def test_map_of_an_asymmetric_unit(spark):
    g = spacegroup("P 21 21 21")
    whole = grid.symmetrized(wave(spark), g, SIZE, "avg")
    part = whole.withColumn("_o", F.array_min(grid.grid_images(g, SIZE))).where("u = _o.u and v = _o.v and w = _o.w").drop("_o")
    back = full_cell_map(part, g, SIZE)
    assert part.count() < 200 and back.count() == 512
    assert back.join(whole.withColumnRenamed("value", "x"), ["u", "v", "w"]).agg(F.max(F.abs(F.col("value") - F.col("x")))).first()[0] < 1e-9


def test_mtz_writer(spark, tmp_path):
    register(spark)
    df = spark.createDataFrame([(2, 0, 1, 5.5), (1, 0, 0, None), (1, -1, 3, 2.25)], "h int, k int, l int, F double")
    assert write_mtz(df, f"{tmp_path}/w.mtz", [("F", "F")], [10, 20, 30, 90, 90, 90], "P 1", 1, ["X, Y, Z"]) == 3
    got = spark.read.format("mtz").load(f"{tmp_path}/w.mtz").orderBy("row").collect()
    assert [(r.h, r.k, r.l, r.F) for r in got] == [(1, -1, 3, 2.25), (1, 0, 0, None), (2, 0, 1, 5.5)]
    assert mtz_bytes([("H", "H")], np.zeros((0, 1)), [1] * 6, "P 1", 1, [])[:4] == b"MTZ "


def test_xds_observations(spark):
    d = spark.createDataFrame([(-1, 2, 3, 10.0, 1.0, [5.0, 6.0, 7.9]), (1, 2, 3, 10.0, -1.0, [5.0, 6.0, 7.9])], "h int, k int, l int, iobs double, sigma double, fields array<double>")
    assert [tuple(r) for r in xds_observations(d, spacegroup("P 21 21 21")).collect()] == [(1, 2, 3, 8, 7, 10.0, 1.0)]


def test_topology(spark):
    atoms = spark.createDataFrame([(1, "ALA", "N", 0.0, 0.0, 0.0), (1, "ALA", "CA", 1.5, 0.0, 0.0), (1, "ALA", "C", 1.5, 1.5, 0.0)], "res_id int, resname string, name string, x double, y double, z double")
    bonds = spark.createDataFrame([("ALA", "N", "CA", 1.4, 0.02)], "comp_id string, a string, b string, ideal double, esd double")
    b = topology.bond_instances(atoms, bonds)
    assert b.first().value == pytest.approx(1.5) and topology.outliers(b).first().z == pytest.approx(5.0)
    angles = spark.createDataFrame([("ALA", "N", "CA", "C", 110.0, 2.0)], "comp_id string, atom1 string, atom2 string, atom3 string, ideal double, esd double")
    assert topology.angle_instances(atoms, angles).first().value == pytest.approx(90.0)
    pairs = spark.createDataFrame([(1, "ALA", "peptide", "GLY", "peptide"), (2, "X", None, "Y", None)], "pair_id int, resname_1 string, resgroup_1 string, resname_2 string, resgroup_2 string")
    links = spark.createDataFrame([("ANY", None, None, None, None), ("TRANS", None, "peptide", None, "peptide"), ("SPECIAL", "ALA", None, None, "peptide")], "link string, comp_1 string, group_1 string, comp_2 string, group_2 string")
    assert {r.pair_id: r.link for r in topology.link_scores(pairs, links).collect()} == {1: "SPECIAL", 2: "ANY"}


def test_hydrogens(spark):
    def row(name, n_h, *near):
        return (1, name, 0.0, 0.0, 0.0, n_h, 1.0, [dict(zip("xyz", map(float, q), strict=True)) for q in near])

    df = spark.createDataFrame([row("A", 1, (1, 1, 1), (-1, -1, 1), (1, -1, -1)), row("B", 2, (1, 1, 0), (-1, 1, 0)), row("C", 3, (0, 0, 1)), row("D", 1, (1, 1, 0), (-1, 1, 0))], "res_id int, name string, x double, y double, z double, n_h int, length double, neighbours array<struct<x:double,y:double,z:double>>")
    got = topology.placed_hydrogens(df).collect()
    at = lambda n: np.array([[r.x, r.y, r.z] for r in got if r.name == n])
    assert at("A")[0] == pytest.approx(np.array([-1, 1, -1]) / 3**0.5) and at("D")[0] == pytest.approx([0, -1, 0])
    assert at("B")[0] @ at("B")[1] == pytest.approx(np.cos(np.radians(109.5)), abs=1e-3)
    assert at("C").shape == (3, 3) and (at("C")[:, 2] == pytest.approx(-1 / 3, abs=1e-3))


@pytest.mark.parametrize("name", ["merge_stats_y", "selection_cid", "neighbours", "matched_correlation", "asu_map", "check_parents", "tag_statistics", "grid_symmetrized"])
def test_plans_have_no_cross_joins(spark, name):
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_selections_reach_the_scan(spark, tmp_path):
    from braggframe.operators.selection import cid

    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    catalog.atoms(spark, "/root/testdata/sf0.001").write.parquet(f"{tmp_path}/atoms")
    df = spark.read.parquet(f"{tmp_path}/atoms").where(cid("/1/2/5-80/CA;b<50")).select("serial", "x")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(chain,2)" in plan and "LessThan(b_iso,50.0)" in plan and "resname" not in plan.split("ReadSchema")[1]
