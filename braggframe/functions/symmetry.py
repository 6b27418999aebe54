"""Space-group symmetry: operations on the driver, and Column expressions generated from them.

An operation is a 3 x 3 matrix and a translation, both in 24ths. A group has at most 192 operations, so groups are
closed on the driver and enter plans as arithmetic on h, k, l or x, y, z that Catalyst compiles.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from fractions import Fraction
from functools import cached_property, reduce
from itertools import product

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

DEN = 24


@dataclass(frozen=True)
class Op:
    rot: tuple[tuple[int, int, int], ...] = ((DEN, 0, 0), (0, DEN, 0), (0, 0, DEN))
    tran: tuple[int, int, int] = (0, 0, 0)

    def __mul__(self, other: Op) -> Op:
        a, b = np.array(self.rot), np.array(other.rot)
        return _op(a @ b // DEN, (a @ np.array(other.tran)) // DEN + np.array(self.tran))

    @property
    def wrapped(self) -> Op:
        return Op(self.rot, tuple(t % DEN for t in self.tran))

    @property
    def det(self) -> int:
        return round(np.linalg.det(np.array(self.rot) / DEN))

    @property
    def order(self) -> int:
        """Rotation order, negative for improper ones, from determinant and trace."""
        trace = (self.rot[0][0] + self.rot[1][1] + self.rot[2][2]) // DEN * self.det
        return self.det * {3: 1, -1: 2, 0: 3, 1: 4, 2: 6}[trace]

    def inverse(self) -> Op:
        inv = np.linalg.inv(np.array(self.rot) / DEN)
        return _op(np.rint(inv * DEN).astype(int), np.rint(-inv @ np.array(self.tran)).astype(int))

    def triplet(self, letters: str = "xyz") -> str:
        out = []
        for row, t in zip(self.rot, self.tran, strict=True):
            terms = ""
            for x, c in zip(letters, row, strict=True):
                if c:
                    f = Fraction(abs(c), DEN)
                    terms += ("-" if c < 0 else "+" if terms else "") + ("" if f == 1 else f"{f}*") + x
            if t:
                f = Fraction(t, DEN)
                terms += f"{'+' if f > 0 and terms else ''}{f}"
            out.append(terms or "0")
        return ",".join(out)

    def on_hkl(self, h: int, k: int, l: int) -> tuple[int, int, int]:
        m = np.array([h, k, l]) @ np.array(self.rot)
        return tuple(int(x) // DEN for x in m)

    def phase_shift(self, h: int, k: int, l: int) -> float:
        return -2 * np.pi * (h * self.tran[0] + k * self.tran[1] + l * self.tran[2]) / DEN


def _op(rot, tran) -> Op:
    return Op(tuple(tuple(int(x) for x in r) for r in rot), tuple(int(t) for t in tran))


def parse_triplet(text: str) -> Op:
    """An operation from 'x,y+1/2,-z', also with a, b, c or h, k, l for the axes; reciprocal-space triplets are transposed."""
    parts = text.replace(" ", "").lower().split(",")
    if len(parts) != 3:
        raise ValueError(f"not a triplet: {text!r}")
    axes = {"x": 0, "y": 1, "z": 2, "a": 0, "b": 1, "c": 2, "h": 0, "k": 1, "l": 2}
    rot, tran = np.zeros((3, 3), int), np.zeros(3, int)
    for i, part in enumerate(parts):
        terms = re.findall(r"([+-]?)(\d+(?:\.\d+)?(?:/\d+)?)?\*?([xyzabchkl])?(?:/(\d+))?", part)
        if not part or "".join(m[0] + m[1] + m[2] for m in terms) == "":
            raise ValueError(f"not a triplet: {text!r}")
        for sign, number, axis, below in terms:
            if not number and not axis:
                continue
            value = Fraction(number or "1") / int(below or 1) * (-1 if sign == "-" else 1) * DEN
            if value.denominator != 1:
                raise ValueError(f"not in 24ths: {text!r}")
            if axis:
                rot[i, axes[axis]] += int(value)
            else:
                tran[i] += int(value)
    return _op(rot.T if set("hkl") & set(text.lower()) else rot, tran)


#: Centring vectors in 24ths.
CENTRING = {
    "P": [(0, 0, 0)], "A": [(0, 0, 0), (0, 12, 12)], "B": [(0, 0, 0), (12, 0, 12)], "C": [(0, 0, 0), (12, 12, 0)],
    "I": [(0, 0, 0), (12, 12, 12)], "R": [(0, 0, 0), (16, 8, 8), (8, 16, 16)], "S": [(0, 0, 0), (8, 8, 16), (16, 16, 8)],
    "T": [(0, 0, 0), (8, 16, 8), (16, 8, 16)], "H": [(0, 0, 0), (16, 8, 0), (8, 16, 0)], "F": [(0, 0, 0), (0, 12, 12), (12, 0, 12), (12, 12, 0)],
}
_TURNS = {
    "1z": [[1, 0, 0], [0, 1, 0], [0, 0, 1]], "2z": [[-1, 0, 0], [0, -1, 0], [0, 0, 1]], "3z": [[0, -1, 0], [1, -1, 0], [0, 0, 1]],
    "4z": [[0, -1, 0], [1, 0, 0], [0, 0, 1]], "6z": [[1, -1, 0], [1, 0, 0], [0, 0, 1]],
    "2'z": [[0, -1, 0], [-1, 0, 0], [0, 0, -1]], '2"z': [[0, 1, 0], [1, 0, 0], [0, 0, -1]], "3*z": [[0, 0, 1], [1, 0, 0], [0, 1, 0]],
}
_SHIFTS = {"a": (12, 0, 0), "b": (0, 12, 0), "c": (0, 0, 12), "n": (12, 12, 12), "u": (6, 0, 0), "v": (0, 6, 0), "w": (0, 0, 6), "d": (6, 6, 6)}


class Group:
    """A closed set of operations modulo lattice translations."""

    def __init__(self, generators: list[Op]):
        seen = {Op().wrapped}
        queue = [Op()]
        generators = [g.wrapped for g in generators]
        while queue:
            a = queue.pop()
            for g in generators:
                b = (a * g).wrapped
                if b not in seen:
                    seen.add(b)
                    queue.append(b)
            if len(seen) > 192 * 8:
                raise ValueError("the operations do not close")
        self.ops = sorted(seen, key=lambda o: (o != Op(), o.rot != Op().rot, o.tran, tuple(-x for r in o.rot for x in r)))

    @cached_property
    def centring(self) -> list[tuple[int, int, int]]:
        return sorted(o.tran for o in self.ops if o.rot == Op().rot)

    @cached_property
    def sym_ops(self) -> list[Op]:
        """One operation a rotation: that of the smallest translation."""
        first: dict = {}
        for o in self.ops:
            if o.rot not in first or o.tran < first[o.rot].tran:
                first[o.rot] = o
        return sorted(first.values(), key=lambda o: o != Op())

    @property
    def centrosymmetric(self) -> bool:
        return any(o.rot == tuple(tuple(-x for x in r) for r in Op().rot) for o in self.ops)

    def same_as(self, other: Group) -> bool:
        return set(self.ops) == set(other.ops)

    def changed_basis(self, change: Op) -> Group:
        back = change.inverse()
        return Group([change * o * back for o in self.ops])

    # Expressions. h, k, l and x, y, z are Columns.
    def images(self, x: Column, y: Column, z: Column) -> Column:
        """Array of structs (op, x, y, z): the fractional position under every operation."""
        rows = []
        for i, o in enumerate(self.ops):
            xyz = [sum((F.lit(c / DEN) * v for c, v in zip(r, (x, y, z), strict=True) if c), F.lit(t / DEN)) for r, t in zip(o.rot, o.tran, strict=True)]
            rows.append(F.struct(F.lit(i).alias("op"), *(v.alias(n) for v, n in zip(xyz, "xyz", strict=True))))
        return F.array(*rows)

    def equivalents(self, h: Column, k: Column, l: Column) -> Column:
        """Array of structs (op, h, k, l, shift): the reflection under every rotation, and the phase shift in degrees."""
        rows = []
        for i, o in enumerate(self.sym_ops):
            hkl = hkl_under(o, h, k, l)
            shift = F.lit(0.0) - (h * o.tran[0] + k * o.tran[1] + l * o.tran[2]) * (360.0 / DEN)
            rows.append(F.struct(F.lit(i).alias("op"), *(v.cast("int").alias(n) for v, n in zip(hkl, "hkl", strict=True)), shift.alias("shift")))
        return F.array(*rows)

    def is_centric(self, h: Column, k: Column, l: Column) -> Column:
        tests = [_all([-a == b for a, b in zip((h, k, l), hkl_under(o, h, k, l), strict=True)]) for o in self.sym_ops]
        return reduce(lambda a, b: a | b, tests)

    def epsilon(self, h: Column, k: Column, l: Column, with_centring: bool = True) -> Column:
        fixed = [F.when(_all([a == b for a, b in zip((h, k, l), hkl_under(o, h, k, l), strict=True)]), 1).otherwise(0) for o in self.sym_ops]
        return reduce(lambda a, b: a + b, fixed) * (len(self.centring) if with_centring else 1)

    def is_absent(self, h: Column, k: Column, l: Column) -> Column:
        """Whether centring or a screw axis or glide plane forbids the reflection."""
        at = lambda t: (h * t[0] + k * t[1] + l * t[2]) % DEN != 0
        tests = [at(c) for c in self.centring if any(c)]
        for o in self.sym_ops:
            if o.rot != Op().rot and any(any((t + c) % DEN for t, c in zip(o.tran, v, strict=True)) for v in self.centring):
                fixed = _all([a == b for a, b in zip((h, k, l), hkl_under(o, h, k, l), strict=True)])
                shifted = reduce(lambda a, b: a | b, [at(tuple(t + c for t, c in zip(o.tran, v, strict=True))) for v in self.centring])
                tests.append(fixed & shifted)
        return reduce(lambda a, b: a | b, tests, F.lit(False))

    def to_asu(self, h: Column, k: Column, l: Column) -> Column:
        """Struct (h, k, l, isym): the first equivalent in the reciprocal asymmetric unit; ISYM 2n - 1, or 2n for its Friedel mate."""
        inside = asu_condition(self)
        choice = None
        for n, o in reversed(list(enumerate(self.sym_ops, 1))):
            hkl = hkl_under(o, h, k, l)
            for sign, isym in ((-1, 2 * n), (1, 2 * n - 1)):
                hh = [v * sign for v in hkl]
                row = F.struct(*(v.cast("int").alias(c) for v, c in zip(hh, "hkl", strict=True)), F.lit(isym).alias("isym"))
                test = F.when(inside(*hh), row)
                choice = test if choice is None else test.otherwise(choice)
        return choice


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests)


def hkl_under(o: Op, h: Column, k: Column, l: Column) -> list[Column]:
    """h' j = sum of h i R ij, exact for the integers of a group's operations."""
    out = []
    for j in range(3):
        terms = [v * (o.rot[i][j] // DEN) if o.rot[i][j] % DEN == 0 else v * (o.rot[i][j] / DEN) for i, v in enumerate((h, k, l)) if o.rot[i][j]]
        out.append(reduce(lambda a, b: a + b, terms) if terms else h * 0)
    return out


def parse_hall(symbol: str) -> Group:
    """The group of a Hall symbol, in the explicit notation: lattice, rotations with axes and translations, origin shift."""
    words = symbol.replace("_", " ").split()
    shift = None
    if "(" in symbol:
        inner = symbol[symbol.index("(") + 1 : symbol.index(")")]
        words = symbol[: symbol.index("(")].replace("_", " ").split()
        shift = Op(tran=tuple(int(x) * 2 for x in inner.split())) if "," not in inner else parse_triplet(inner)
    lattice = words[0].lstrip("-")
    generators = [Op(tran=t) for t in CENTRING[lattice]]
    if words[0].startswith("-"):
        generators.append(_op(-DEN * np.eye(3, dtype=int), (0, 0, 0)))
    before = None
    for n, word in enumerate(words[1:], 1):
        m = re.fullmatch(r"(-?)([12346])(['\"*]?)([xyz]?)(['\"*]?)([1-5abcnuvwd]*)", word)
        if not m:
            raise ValueError(f"not a Hall symbol: {symbol!r}")
        improper, order, prime, axis, prime2, more = m.groups()
        order, prime = int(order), prime or prime2
        if not axis and not prime:
            if n == 2 and order == 2:
                if before[0] in (2, 4):
                    axis = "x"
                elif before[0] in (3, 6):
                    prime = "'"
            elif n == 3 and order == 3:
                prime = "*"
        axis = axis or ("z" if n == 1 or prime == "*" else before[1] if prime else "z")
        if n == 3 and order == 3 and prime == "*":
            turn = np.array(_TURNS["3*z"])
        elif prime == "*":
            turn = np.array(_TURNS["3*z"])
        else:
            turn = np.array(_TURNS[f"{order}{prime}z"])
            for _ in range({"z": 0, "x": 1, "y": 2}[axis]):  # cyclic permutation of the axes
                p = np.array([[0, 0, 1], [1, 0, 0], [0, 1, 0]])
                turn = p @ turn @ p.T
        if improper:
            turn = -turn
        tran = np.zeros(3, int)
        for c in more:
            if c.isdigit():
                tran["xyz".index(axis)] += DEN * int(c) // order
            else:
                tran += np.array(_SHIFTS[c])
        generators.append(_op(turn * DEN, tran % DEN))
        before = (order, axis)
    if shift:
        generators = [(shift * g * shift.inverse()).wrapped for g in generators]
    return Group(generators)


# International Tables number, Hermann-Mauguin name, Hall symbol of settings in common use.
SPACEGROUPS = [
    (1, "P 1", "P 1"), (2, "P -1", "-P 1"), (3, "P 1 2 1", "P 2y"), (4, "P 1 21 1", "P 2yb"), (5, "C 1 2 1", "C 2y"), (5, "I 1 2 1", "I 2y"),
    (6, "P 1 m 1", "P -2y"), (7, "P 1 c 1", "P -2yc"), (8, "C 1 m 1", "C -2y"), (9, "C 1 c 1", "C -2yc"), (10, "P 1 2/m 1", "-P 2y"), (11, "P 1 21/m 1", "-P 2yb"),
    (12, "C 1 2/m 1", "-C 2y"), (13, "P 1 2/c 1", "-P 2yc"), (14, "P 1 21/c 1", "-P 2ybc"), (14, "P 1 21/n 1", "-P 2yn"), (15, "C 1 2/c 1", "-C 2yc"),
    (16, "P 2 2 2", "P 2 2"), (17, "P 2 2 21", "P 2c 2"), (18, "P 21 21 2", "P 2 2ab"), (19, "P 21 21 21", "P 2ac 2ab"), (20, "C 2 2 21", "C 2c 2"), (21, "C 2 2 2", "C 2 2"),
    (22, "F 2 2 2", "F 2 2"), (23, "I 2 2 2", "I 2 2"), (24, "I 21 21 21", "I 2b 2c"), (25, "P m m 2", "P 2 -2"), (29, "P c a 21", "P 2c -2ac"), (33, "P n a 21", "P 2c -2n"),
    (47, "P m m m", "-P 2 2"), (60, "P b c n", "-P 2n 2ab"), (61, "P b c a", "-P 2ac 2ab"), (62, "P n m a", "-P 2ac 2n"), (63, "C m c m", "-C 2c 2"), (69, "F m m m", "-F 2 2"), (71, "I m m m", "-I 2 2"),
    (75, "P 4", "P 4"), (76, "P 41", "P 4w"), (77, "P 42", "P 4c"), (78, "P 43", "P 4cw"), (79, "I 4", "I 4"), (80, "I 41", "I 4bw"), (81, "P -4", "P -4"), (82, "I -4", "I -4"),
    (83, "P 4/m", "-P 4"), (87, "I 4/m", "-I 4"), (88, "I 41/a", "-I 4ad"), (89, "P 4 2 2", "P 4 2"), (90, "P 4 21 2", "P 4ab 2ab"), (91, "P 41 2 2", "P 4w 2c"), (92, "P 41 21 2", "P 4abw 2nw"),
    (93, "P 42 2 2", "P 4c 2"), (94, "P 42 21 2", "P 4n 2n"), (95, "P 43 2 2", "P 4cw 2c"), (96, "P 43 21 2", "P 4nw 2abw"), (97, "I 4 2 2", "I 4 2"), (98, "I 41 2 2", "I 4bw 2bw"),
    (123, "P 4/m m m", "-P 4 2"), (139, "I 4/m m m", "-I 4 2"), (143, "P 3", "P 3"), (144, "P 31", "P 31"), (145, "P 32", "P 32"), (146, "R 3:H", "R 3"), (147, "P -3", "-P 3"), (148, "R -3:H", "-R 3"),
    (149, "P 3 1 2", "P 3 2"), (150, "P 3 2 1", 'P 3 2"'), (151, "P 31 1 2", "P 31 2 (0 0 4)"), (152, "P 31 2 1", 'P 31 2"'), (153, "P 32 1 2", "P 32 2 (0 0 2)"), (154, "P 32 2 1", 'P 32 2"'), (155, "R 3 2:H", 'R 3 2"'),
    (166, "R -3 m:H", '-R 3 2"'), (168, "P 6", "P 6"), (169, "P 61", "P 61"), (170, "P 65", "P 65"), (171, "P 62", "P 62"), (172, "P 64", "P 64"), (173, "P 63", "P 6c"), (175, "P 6/m", "-P 6"), (176, "P 63/m", "-P 6c"),
    (177, "P 6 2 2", "P 6 2"), (178, "P 61 2 2", "P 61 2 (0 0 5)"), (179, "P 65 2 2", "P 65 2 (0 0 1)"), (180, "P 62 2 2", "P 62 2 (0 0 4)"), (181, "P 64 2 2", "P 64 2 (0 0 2)"), (182, "P 63 2 2", "P 6c 2c"),
    (191, "P 6/m m m", "-P 6 2"), (194, "P 63/m m c", "-P 6c 2c"), (195, "P 2 3", "P 2 2 3"), (196, "F 2 3", "F 2 2 3"), (197, "I 2 3", "I 2 2 3"), (198, "P 21 3", "P 2ac 2ab 3"), (199, "I 21 3", "I 2b 2c 3"),
    (200, "P m -3", "-P 2 2 3"), (207, "P 4 3 2", "P 4 2 3"), (208, "P 42 3 2", "P 4n 2 3"), (209, "F 4 3 2", "F 4 2 3"), (210, "F 41 3 2", "F 4d 2 3"), (211, "I 4 3 2", "I 4 2 3"),
    (212, "P 43 3 2", "P 4acd 2ab 3"), (213, "P 41 3 2", "P 4bd 2ab 3"), (214, "I 41 3 2", "I 4bd 2c 3"), (221, "P m -3 m", "-P 4 2 3"), (225, "F m -3 m", "-F 4 2 3"), (227, "F d -3 m:2", "-F 4vw 2vw 3"), (229, "I m -3 m", "-I 4 2 3"), (230, "I a -3 d", "-I 4bd 2c 3"),
]


def crystal_system(number: int) -> str:
    bounds = [(2, "triclinic"), (15, "monoclinic"), (74, "orthorhombic"), (142, "tetragonal"), (167, "trigonal"), (194, "hexagonal"), (230, "cubic")]
    return next(name for last, name in bounds if number <= last)


def spacegroup(name: str) -> Group:
    """A group by Hermann-Mauguin name (spaces optional, H for R settings optional) or number."""
    plain = lambda s: re.sub(r"[\s:]", "", s).removesuffix("H").lower()
    short = lambda hm: plain(re.sub(r" 1(?= |$)", "", hm)) if re.match(r"[PCI] 1 \S+ 1$", hm) else plain(hm)
    for number, hm, hall in SPACEGROUPS:
        if str(number) == name or plain(hm) == plain(name) or short(hm) == plain(name):
            return parse_hall(hall)
    raise ValueError(f"no space group {name!r}")


def laue_class(group: Group) -> str:
    """The Laue class, from how many rotations of each order the point group holds."""
    rots = {o.rot for o in group.sym_ops}
    orders = [abs(Op(r).order) for r in {tuple(tuple(x * Op(r).det for x in row) for row in r) for r in rots}]
    n3, n4, n6, n2 = (orders.count(i) for i in (3, 4, 6, 2))
    if n3 == 8:
        return "m-3m" if n4 else "m-3"
    if n6:
        return "6/mmm" if n2 > 1 else "6/m"
    if n3:
        return "-3m" if n2 else "-3"
    if n4:
        return "4/mmm" if n2 > 1 else "4/m"
    return {0: "-1", 1: "2/m", 3: "mmm"}[n2]


def asu_condition(group: Group):
    """The condition (h, k, l) -> bool of a reciprocal asymmetric unit for the group's Laue class, unique axis b or c."""
    laue = laue_class(group)
    h31 = laue == "-3m" and any(o.rot == ((0, -DEN, 0), (-DEN, 0, 0), (0, 0, -DEN)) for o in group.sym_ops)
    # Conventional half-, quarter- ... spaces of the Laue classes.
    rules = {
        "-1": lambda h, k, l: (l > 0) | ((l == 0) & ((h > 0) | ((h == 0) & (k >= 0)))),
        "2/m": lambda h, k, l: (k >= 0) & ((l > 0) | ((l == 0) & (h >= 0))),
        "mmm": lambda h, k, l: (h >= 0) & (k >= 0) & (l >= 0),
        "4/m": lambda h, k, l: (l >= 0) & (((h >= 0) & (k > 0)) | ((h == 0) & (k == 0))),
        "4/mmm": lambda h, k, l: (h >= k) & (k >= 0) & (l >= 0),
        "-3": lambda h, k, l: ((h >= 0) & (k > 0)) | ((h == 0) & (k == 0) & (l >= 0)),
        "-3m": (lambda h, k, l: (h >= k) & (k >= 0) & ((k > 0) | (l >= 0))) if h31 else (lambda h, k, l: (h >= k) & (k >= 0) & ((h > k) | (l >= 0))),
        "6/m": lambda h, k, l: (l >= 0) & (((h >= 0) & (k > 0)) | ((h == 0) & (k == 0))),
        "6/mmm": lambda h, k, l: (h >= k) & (k >= 0) & (l >= 0),
        "m-3": lambda h, k, l: (h >= 0) & (((l >= h) & (k > h)) | ((l == h) & (k == h))),
        "m-3m": lambda h, k, l: (k >= l) & (l >= h) & (h >= 0),
    }
    if laue == "2/m" and not any(o.rot[1][1] * o.det > 0 and o.rot[0][0] * o.det < 0 for o in group.sym_ops):
        return lambda h, k, l: rules["2/m"](k, l, h)
    return rules[laue]


def grid_factors(group: Group) -> tuple[int, int, int]:
    """Numbers that a grid's sizes must be multiples of, so that every operation maps points to points."""
    out = [1, 1, 1]
    for o in group.ops:
        for i in range(3):
            out[i] = int(np.lcm(out[i], Fraction(o.tran[i], DEN).denominator))
    for o, (i, j) in product(group.sym_ops, ((0, 1), (0, 2), (1, 2))):
        if o.rot[i][j] or o.rot[j][i]:
            out[i] = out[j] = int(np.lcm(out[i], out[j]))
    return tuple(out)
