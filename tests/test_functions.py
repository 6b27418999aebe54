import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from braggframe.functions import values
from braggframe.functions.cell import Cell, niggli
from braggframe.functions.symmetry import SPACEGROUPS, Group, Op, grid_factors, laue_class, parse_hall, parse_triplet, spacegroup

ORDERS = {"P 1": 1, "P 21 21 21": 4, "C 1 2 1": 4, "P 43 21 2": 8, "I 41 2 2": 16, "P 61 2 2": 12, "R 3 2:H": 18, "F m -3 m": 192, "I a -3 d": 96, "P 41 3 2": 24, "F d -3 m:2": 192, "I m -3 m": 96}


@pytest.mark.parametrize("name", ORDERS)
def test_group_orders(name):
    assert len(spacegroup(name).ops) == ORDERS[name]


def test_every_setting_closes():
    for _, hm, hall in SPACEGROUPS:
        g = parse_hall(hall)
        assert len(g.ops) == len(g.sym_ops) * len(g.centring), hm
        assert all((a * b).wrapped in set(g.ops) for a in g.ops[:4] for b in g.ops[-4:])


def test_triplets_round_trip():
    for text in ("x,y,z", "-x,y+1/2,-z+1/2", "y,x-y,z+5/6", "-y,-x,-z"):
        assert parse_triplet(text).triplet() == text
    assert parse_triplet("x, y + 1/4, 1/3 - z").tran == (0, 6, 8)
    with pytest.raises(ValueError):
        parse_triplet("x,y")


def test_op_algebra():
    a = parse_triplet("-y,x-y,z+1/3")
    assert (a * a.inverse()).wrapped == Op()
    assert a.order == 3 and parse_triplet("-x,-y,-z").order == -1


def test_fixed_operations_of_p212121():
    want = {"x,y,z", "-x+1/2,-y,z+1/2", "x+1/2,-y+1/2,-z", "-x,y+1/2,-z+1/2"}
    assert {o.triplet() for o in spacegroup("P212121").ops} == want
    assert grid_factors(spacegroup("P 61 2 2")) == (1, 1, 6)
    assert laue_class(spacegroup("P 3 1 2")) == "-3m"
    assert spacegroup("P 2 2 2").same_as(Group([parse_triplet("-x,-y,z"), parse_triplet("x,-y,-z")]))


def test_absences_and_epsilon(spark):
    g = spacegroup("P 43 21 2")
    df = spark.createDataFrame([(0, 0, 4), (0, 0, 2), (3, 0, 0), (2, 0, 0), (1, 2, 3)], "h int, k int, l int")
    rows = {tuple(r[:3]): r[3:] for r in df.select("h", "k", "l", g.is_absent(F.col("h"), F.col("k"), F.col("l")), g.epsilon(F.col("h"), F.col("k"), F.col("l"))).collect()}
    assert rows[0, 0, 4] == (False, 4) and rows[0, 0, 2][0] and rows[3, 0, 0][0] and not rows[2, 0, 0][0]
    assert rows[1, 2, 3] == (False, 1)


@pytest.mark.parametrize("name", ["P 1", "P 1 21 1", "P 21 21 21", "P 4", "P 43 21 2", "P 3", "P 3 2 1", "P 3 1 2", "P 6", "P 6 2 2", "P 2 3", "P 4 3 2", "C 1 2 1"])
def test_asymmetric_unit_is_a_partition(spark, name):
    """All equivalents of a reflection and their Friedel mates map to one reflection."""
    g = spacegroup(name)
    a = spark.range(-3, 4).select(F.col("id").cast("int").alias("h"))
    df = a.crossJoin(a.select(F.col("h").alias("k"))).crossJoin(a.select(F.col("h").alias("l"))).withColumn("e", F.explode(g.equivalents(F.col("h"), F.col("k"), F.col("l"))))
    m = df.select("h", "k", "l", g.to_asu(F.col("e.h"), F.col("e.k"), F.col("e.l")).alias("a"))
    assert m.where("a is null").count() == 0
    assert m.groupBy("h", "k", "l").agg(F.countDistinct("a.h", "a.k", "a.l").alias("n")).where("n > 1").count() == 0


def test_cell():
    c = Cell(10, 12, 14, 80, 100, 110)
    assert c.volume == pytest.approx(abs(np.linalg.det(c.orth)))
    assert Cell(10, 10, 10).orth == pytest.approx(np.eye(3) * 10)
    reduced, _ = niggli(c)
    assert reduced.volume == pytest.approx(c.volume) and reduced.a <= reduced.b <= reduced.c
    skew, _ = niggli(Cell.from_metric(np.array([[1, 1, 0], [0, 1, 2], [0, 0, 1]]).T @ Cell(5, 6, 7).metric @ np.array([[1, 1, 0], [0, 1, 2], [0, 0, 1]])))
    assert sorted([skew.a, skew.b, skew.c]) == pytest.approx([5, 6, 7])


def test_values(spark):
    rows = [("1.234(5)", 1.234), ("+2", 2.0), ("-.5e3", -500.0), ("?", None), ("1-0", None), ("inf", None), ("'3'", None), ("7.", 7.0), ("", None)]
    df = spark.createDataFrame([(r[0],) for r in rows], "v string")
    assert [r[0] for r in df.select(values.cif_number(F.col("v"))).collect()] == [r[1] for r in rows]
    quoted = [("a b", "'a b'"), ("it's", "it's"), ("", "''"), ("?", "'?'"), ("data_x", "'data_x'"), ("a' b", '"a\' b"'), ("two\nlines", ";two\nlines\n;")]
    df = spark.createDataFrame([(q[0],) for q in quoted], "v string")
    out = df.select("v", values.cif_quoted(F.col("v")).alias("q")).select("v", "q", values.cif_string(F.col("q")).alias("s")).collect()
    assert [r.q for r in out] == [q[1] for q in quoted] and all(r.s == r.v for r in out)


def test_hybrid36():
    for n in (0, 9999, 10000, 10000 + 26 * 36**3 - 1, 10000 + 26 * 36**3):
        assert values.from_hybrid36(values.hybrid36(n, 4)) == n
    assert values.hybrid36(10000, 4) == "A000" and values.hybrid36(99999, 5) == "99999"
    assert math.isfinite(1)


def test_hybrid36_columns(spark):
    for width in (4, 5):
        span = 26 * 36 ** (width - 1)
        numbers = [-7, 0, 10**width - 1, 10**width, 10**width + 48, 10**width + span - 1, 10**width + span, 10**width + 2 * span - 1]
        df = spark.createDataFrame([(n,) for n in numbers], "n int").select("n", values.hybrid36_text(F.col("n"), width).alias("t"))
        got = df.select("n", "t", values.hybrid36_int(F.col("t"), width).alias("back")).collect()
        assert [r.back for r in got] == numbers and [r.t for r in got[1:]] == [values.hybrid36(n, width).strip() for n in numbers[1:]]
    odd = spark.createDataFrame([("",), ("A00",), ("A00-",), ("x",), ("12",)], "t string")
    assert [r[0] for r in odd.select(values.hybrid36_int(F.col("t"), 4)).collect()] == [None, None, None, None, 12]


def test_named_settings_have_the_order_of_their_point_group():
    """Operations, centring vectors and inversion of every named setting against what its number and letter say."""
    from braggframe.functions.symmetry import SPACEGROUPS, crystal_system, laue_class, parse_hall, spacegroup

    ends = ((2, "triclinic"), (15, "monoclinic"), (74, "orthorhombic"), (142, "tetragonal"), (167, "trigonal"), (194, "hexagonal"), (230, "cubic"))
    most = {"triclinic": 2, "monoclinic": 4, "orthorhombic": 8, "tetragonal": 16, "trigonal": 12, "hexagonal": 24, "cubic": 48}
    for number, name, hall in SPACEGROUPS:
        g = parse_hall(hall)
        system = next(s for end, s in ends if number <= end)
        assert crystal_system(number) == system and most[system] % len(g.sym_ops) == 0
        if name[0] != "R":  # there the axes decide
            assert len(g.centring) == {"P": 1, "A": 2, "B": 2, "C": 2, "I": 2, "F": 4}[name[0]]
        assert len(g.ops) == len(g.sym_ops) * len(g.centring) and spacegroup(name).same_as(g)
        same = next(o for o in g.sym_ops if o.triplet() == "x,y,z")
        assert g.centrosymmetric == any(tuple(tuple(-x for x in row) for row in o.rot) == tuple(map(tuple, same.rot)) for o in g.sym_ops)
        assert laue_class(g)


def test_twin_laws_of_three_lattices():
    from braggframe.functions.cell import Cell
    from braggframe.functions.symmetry import spacegroup
    from braggframe.operators import lattice

    # The cosets of the group in the lattice's rotations, but the group's own: order / 1 - 1.
    for cell, order in ((Cell(5, 5, 7), 8), (Cell(5, 5, 7, 90, 90, 120), 12), (Cell(5, 5, 5), 24), (Cell(5, 6, 7), 4), (Cell(5, 6, 7, 90, 100, 90), 2), (Cell(5, 6, 7, 80, 100, 95), 1)):
        assert len(lattice.twin_laws(cell, spacegroup("P 1"))) == order - 1
