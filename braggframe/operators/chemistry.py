"""Chemical components: formulas, restraints, bond graphs, rings, small patterns."""

from __future__ import annotations

import re
from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .model import WEIGHTS, table_lookup


def formula_counts(formula: Column) -> Column:
    """Array of (element, count) of a formula such as 'C10 H16 N5'."""
    parts = F.regexp_extract_all(formula, F.lit(r"([A-Z][a-z]?|[A-Z]{2}(?=\d|\s|$))(\d*)"), 0)
    return F.transform(parts, lambda p: F.struct(F.upper(F.regexp_extract(p, "([A-Za-z]+)", 1)).alias("element"), F.coalesce(F.regexp_extract(p, r"(\d+)", 1).try_cast("int"), F.lit(1)).alias("count")))


def formula_weight(formula: Column) -> Column:
    return F.aggregate(formula_counts(formula), F.lit(0.0), lambda t, x: t + table_lookup(x["element"], WEIGHTS, 0.0) * x["count"])


def restraint_values(restraints: DataFrame, atoms: DataFrame) -> DataFrame:
    """value of each restraint (kind, id, names of atoms 1 to 4, ideal, esd, period) from atoms (name, x, y, z) of its residue res_id.

    Bonds are distances, angles and torsions degrees. value is set so that value - ideal is the wrapped difference.
    """
    from ..functions.geometry import angle, dihedral, dist2

    j = restraints
    for i in range(1, 5):
        a = atoms.select("res_id", F.col("name").alias(f"atom{i}"), F.struct("x", "y", "z").alias(f"p{i}"))
        j = j.join(a, ["res_id", f"atom{i}"], "left")
    p = [(F.col(f"p{i}.x"), F.col(f"p{i}.y"), F.col(f"p{i}.z")) for i in range(1, 5)]
    full = F.when(F.col("kind") == "torsion", 360.0 / F.greatest(F.lit(1), F.coalesce("period", F.lit(1)))).otherwise(360.0)
    raw = F.when(F.col("kind") == "bond", F.sqrt(dist2(p[0], p[1]))).when(F.col("kind") == "angle", F.degrees(angle(*p[:3]))).otherwise(F.degrees(dihedral(*p)))
    diff = F.pmod(raw - F.col("ideal") + full / 2, full) - full / 2
    value = F.when(F.col("kind") == "bond", raw).otherwise(F.col("ideal") + diff)
    return j.withColumn("value", value).drop("p1", "p2", "p3", "p4")


def missing_atoms(expected: DataFrame, atoms: DataFrame) -> DataFrame:
    """Atoms of the components (resname, name) that residues (res_id, resname) lack."""
    residues = atoms.select("res_id", "resname").distinct()
    return residues.join(expected, "resname").join(atoms.select("res_id", "name"), ["res_id", "name"], "left_anti")


def modified(restraints: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Restraints after a modification: rows with function add, delete or change, by keys."""
    gone = changes.where("function in ('delete', 'change')").select(*keys).distinct()
    new = changes.where("function in ('add', 'change')").select(*restraints.columns)
    return restraints.join(gone, keys, "left_anti").unionByName(new)


def bond_distance(bonds: DataFrame, start: DataFrame, reach: int = 3) -> DataFrame:
    """Fewest bonds (up to reach) from start atoms: comp_id, a (start), b, n. One join a step."""
    both = bonds.select("comp_id", "a", "b").union(bonds.select("comp_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    found = start.select("comp_id", "a", F.col("a").alias("b"), F.lit(0).alias("n"))
    front = found
    for step in range(1, reach + 1):
        nxt = front.alias("f").join(both.alias("e"), (F.col("f.comp_id") == F.col("e.comp_id")) & (F.col("f.b") == F.col("e.a"))).select("f.comp_id", "f.a", "e.b", F.lit(step).alias("n")).distinct()
        front = nxt.join(found, ["comp_id", "a", "b"], "left_anti")
        found = found.unionByName(front)
    return found


def rings_of(bonds: list[tuple[str, str]], largest: int = 8) -> list[tuple[str, ...]]:
    """A shortest ring through each bond, without repeats, atoms in ring order from the least name, on to its lesser neighbour."""
    graph: dict[str, set[str]] = defaultdict(set)
    for a, b in bonds:
        graph[a].add(b)
        graph[b].add(a)
    found: dict[frozenset, tuple[str, ...]] = {}
    for a, b in bonds:
        queue, seen = deque([(a, (a,))]), {a}
        while queue:
            x, path = queue.popleft()
            if len(path) > largest:
                break
            nexts = sorted(y for y in graph[x] if y not in seen and not (x == a and y == b))
            if b in nexts:
                ring = (*path, b)
                if len(ring) <= largest:
                    i = ring.index(min(ring))
                    ring = ring[i:] + ring[:i]
                    found.setdefault(frozenset(ring), ring if ring[1] < ring[-1] else ring[:1] + ring[:0:-1])
                break
            for y in nexts:
                seen.add(y)
                queue.append((y, (*path, y)))
    return sorted(found.values())


def rings(bonds: DataFrame, largest: int = 8) -> DataFrame:
    """comp_id, size, atoms of the rings of each component's bonds (comp_id, a, b). A component is a molecule: small."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = rings_of(sorted({(min(x), max(x)) for x in zip(pdf["a"], pdf["b"], strict=True)}), largest)
        return pd.DataFrame({"comp_id": [pdf["comp_id"].iloc[0]] * len(r), "size": [len(x) for x in r], "atoms": [list(x) for x in r]})

    return bonds.groupBy("comp_id").applyInPandas(run, "comp_id string, size int, atoms array<string>")


_ATOM = re.compile(r"\[([^\]]*)\]|(Br|Cl|[BCNOPSFI*]|[bcnops])")


def parse_pattern(text: str) -> tuple[list[dict], list[tuple[int, int, str]]]:
    """Atoms and bonds of a SMARTS subset: elements, *, [..] with Hn and Xn, bonds - = # ~, branches and ring closures."""
    atoms, bonds, stack, last, bond, rings, i = [], [], [], None, "", {}, 0
    while i < len(text):
        c = text[i]
        if m := _ATOM.match(text, i):
            body = m[1] if m[1] is not None else m[2]
            symbol = re.match(r"\*|[A-Z][a-z]?(?![a-z])|[a-z]", body)
            rest = body[symbol.end() :] if symbol else body
            name = symbol[0] if symbol else "*"
            atoms.append({"element": name.capitalize() if name != "*" else None, "aromatic": name.islower(), "h": int(x[1] or 1) if (x := re.search(r"H(\d*)", rest)) else None, "x": int(x[1]) if (x := re.search(r"X(\d+)", rest)) else None})
            if last is not None:
                bonds.append((last, len(atoms) - 1, bond))
            last, bond, i = len(atoms) - 1, "", m.end()
            continue
        if c in "-=#~:":
            bond = c
        elif c == "(":
            stack.append(last)
        elif c == ")":
            last = stack.pop()
        elif c.isdigit():
            if c in rings:
                bonds.append((rings.pop(c), last, bond))
                bond = ""
            else:
                rings[c] = last
        else:
            raise ValueError(f"unsupported: {text[i:]!r}")
        i += 1
    return atoms, bonds


def match_pattern(elements: dict[str, str], bonds: dict[tuple[str, str], str], pattern: str, aromatic: frozenset = frozenset()) -> list[tuple[str, ...]]:
    """All placements of a pattern on a molecule: atom names in the pattern's order. Bond orders: SING, DOUB, TRIP, AROM, DELO."""
    want, links = parse_pattern(pattern)
    graph: dict[str, dict[str, str]] = defaultdict(dict)
    for (a, b), order in bonds.items():
        graph[a][b] = graph[b][a] = order.upper()[:4]
    arom = aromatic or {a for (x, y), o in bonds.items() if o.upper()[:4] in ("AROM", "DELO") for a in (x, y)}

    def fits(w: dict, a: str) -> bool:
        return (w["element"] is None or elements[a].capitalize() == w["element"]) and (not w["aromatic"] or a in arom) and (w["x"] is None or len(graph[a]) == w["x"]) and (w["h"] is None or sum(elements[y].upper() in ("H", "D") for y in graph[a]) == w["h"])

    def joined(kind: str, a: str, b: str) -> bool:
        o = graph[a].get(b)
        if o is None:
            return False
        if kind == "":
            return o in ("AROM", "DELO") if a in arom and b in arom else o == "SING"
        return kind == "~" or o in {"-": ("SING",), "=": ("DOUB", "DELO"), "#": ("TRIP",), ":": ("AROM", "DELO")}[kind]

    out: list[tuple[str, ...]] = []

    def place(at: list[str]) -> None:
        n = len(at)
        if n == len(want):
            out.append(tuple(at))
            return
        near = [(i, k) for i, j, k in links if j == n and i < n] + [(j, k) for i, j, k in links if i == n and j < n]
        for a in sorted(graph[at[near[0][0]]] if near else elements):
            if a not in at and fits(want[n], a) and all(joined(k, at[i], a) for i, k in near):
                place([*at, a])

    place([])
    return out


def matches(atoms: DataFrame, bonds: DataFrame, pattern: str) -> DataFrame:
    """comp_id and atoms of every placement of the pattern on the components' graphs (comp_id, name, element; comp_id, a, b, order)."""

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = match_pattern(dict(zip(left["name"], left["element"], strict=True)), {(a, b): o for a, b, o in zip(right["a"], right["b"], right["order"], strict=True)}, pattern)
        return pd.DataFrame({"comp_id": [key[0]] * len(found), "atoms": [list(x) for x in found]})

    return atoms.groupBy("comp_id").cogroup(bonds.groupBy("comp_id")).applyInPandas(run, "comp_id string, atoms array<string>")
