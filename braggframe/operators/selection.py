"""Selection languages for atoms, compiled to one Column predicate.

Atoms have: model, chain, seqnum, icode, resname, atom, altloc, element, occ, b_iso, serial, group_pdb, entity_type.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements that are not metals.
NONMETALS = "H D He B C N O F Ne Si P S Cl Ar Ge As Se Br Kr Te I Xe At Rn Ts Og".split()
WATER = ["HOH", "DOD", "WAT", "H2O"]


def _upper(c: str) -> Column:
    return F.upper(F.col(c))


def _listed(text: str, column: Column) -> Column:
    """'*', 'A,B' or '!A,B'; an empty item is the empty string."""
    if text in ("", "*"):
        return F.lit(True)
    inverse = text.startswith("!")
    test = column.isin([x.strip() for x in text[inverse:].split(",")])
    return ~test if inverse else test


def _seqid(text: str) -> tuple[int | None, str | None]:
    m = re.fullmatch(r"(\*|-?\d+)(?:\.(\*|[A-Za-z]?)|([A-Za-z]))?", text)
    if not m:
        raise ValueError(f"not a residue number: {text!r}")
    icode = m[3] if m[3] is not None else m[2] if m[2] is not None else ""
    return (None if m[1] == "*" else int(m[1])), (None if icode == "*" else icode)


def _sequence(text: str) -> Column:
    if text in ("", "*"):
        return F.lit(True)
    m = re.fullmatch(r"((?:\*|-?\d+)(?:\.?[A-Za-z*]?)?)(?:-((?:\*|-?\d+)(?:\.?[A-Za-z*]?)?))?", text)
    if not m:
        raise ValueError(f"not a range of residues: {text!r}")
    low, high = _seqid(m[1]), _seqid(m[2]) if m[2] else None
    num, code = F.col("seqnum"), F.coalesce("icode", F.lit(""))
    if high is None:
        test = F.lit(True) if low[0] is None else num == low[0]
        return test if low[1] is None else test & (code == low[1])
    tests = []
    for (n, c), less in ((low, False), (high, True)):
        if n is not None:
            out = num < n if less else num > n
            at = (num == n) if c is None else (num == n) & (code <= c if less else code >= c)
            tests.append(out | at)
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def cid(selection: str) -> Column:
    """The slash language: /models/chains/from-to(residues)/atoms[elements]:altlocs;q<0.5;b>9;polymer."""
    text = selection.strip()
    if text in ("", "*"):
        return F.lit(True)
    text, *conditions = text.split(";")
    tests = []
    if text.startswith("/"):
        model, _, text = text[1:].partition("/")
        if model not in ("", "*"):
            tests.append(F.col("model").isin([int(x) for x in model.split(",")]))
        fields = text.split("/") if text else []
    else:
        fields = text.split("/")
        if re.match(r"[\d.(\-]", text):
            fields = ["*", *fields]
        elif len(fields) == 1 and re.search(r"[\[:]", text):
            fields = ["*", "*", text]
    if len(fields) > 3:
        raise ValueError(f"too many fields: {selection!r}")
    chain, residue, atom = (fields + ["*"] * 3)[:3]
    tests.append(_listed(chain, F.col("chain")))
    m = re.fullmatch(r"([^(]*)(?:\(([^)]*)\))?(?:\.([A-Za-z*]?))?", residue)
    if not m:
        raise ValueError(f"not a residue field: {residue!r}")
    tests += [_sequence(m[1]), _listed(m[2] or "*", F.col("resname"))]
    m = re.fullmatch(r"([^\[:]*)(?:\[([^\]]*)\])?(?::(.*))?", atom)
    if not m:
        raise ValueError(f"not an atom field: {atom!r}")
    tests.append(_listed(m[1], F.col("atom")))
    if m[2]:
        inverse, names = m[2].startswith("!"), m[2].lstrip("!")
        if names in ("metals", "nonmetals"):
            test = _upper("element").isin([x.upper() for x in NONMETALS])
            test = ~test if names == "metals" else test
        else:
            test = _upper("element").isin([x.strip().upper() for x in names.split(",")])
        tests.append(~test if inverse else test)
    if m[3] is not None and m[3] != "*":
        tests.append(_listed(m[3], F.coalesce("altloc", F.lit(""))) if m[3] else F.coalesce("altloc", F.lit("")) == "")
    for c in conditions:
        m = re.fullmatch(r"\s*([qb])\s*([<>=])\s*([-+.\deE]+)\s*", c)
        if m:
            x = F.col("occ" if m[1] == "q" else "b_iso")
            tests.append(x < float(m[3]) if m[2] == "<" else x > float(m[3]) if m[2] == ">" else x == float(m[3]))
        elif c.strip().lstrip("!") in ("polymer", "solvent"):
            test = F.col("entity_type") == {"polymer": "polymer", "solvent": "water"}[c.strip().lstrip("!")]
            tests.append(~test if c.strip().startswith("!") else test)
        else:
            raise ValueError(f"not a condition: {c!r}")
    return reduce(lambda a, b: a & b, tests)


_FIELDS = {"chain": "chain", "resn": "resname", "resi": "seqnum", "name": "atom", "alt": "altloc", "elem": "element", "index": "serial", "id": "serial", "b": "b_iso", "q": "occ"}
_SHORT = {"c.": "chain", "r.": "resn", "i.": "resi", "n.": "name", "e.": "elem", "h.": "hydrogens"}


def pymol(selection: str) -> Column:
    """The keyword language: chain A and not (resn HOH or b > 50); or binds loosest, not tightest."""
    words = re.findall(r"\(|\)|<=|>=|!=|<|>|=|!|&|\||[^\s()<>=!&|]+", selection)
    words = [_SHORT.get(w.lower(), w) for w in words]
    at = 0

    def peek() -> str:
        return words[at].lower() if at < len(words) else ""

    def take() -> str:
        nonlocal at
        if at >= len(words):
            raise ValueError(f"ends too early: {selection!r}")
        at += 1
        return words[at - 1]

    def either() -> Column:
        out = both()
        while peek() in ("or", "|"):
            take()
            out = out | both()
        return out

    def both() -> Column:
        out = single()
        while peek() in ("and", "&"):
            take()
            out = out & single()
        return out

    def single() -> Column:
        if peek() in ("not", "!"):
            take()
            return ~single()
        if peek() == "(":
            take()
            out = either()
            if take() != ")":
                raise ValueError(f"a parenthesis is open: {selection!r}")
            return out
        return term()

    def term() -> Column:
        word = take().lower()
        hydrogen = _upper("element").isin("H", "D")
        fixed = {
            "all": F.lit(True), "none": F.lit(False), "hetatm": F.col("group_pdb") == "HETATM", "polymer": F.col("entity_type") == "polymer",
            "solvent": F.col("resname").isin(WATER), "water": F.col("resname").isin(WATER), "hydrogens": hydrogen, "hydro": hydrogen,
            "backbone": F.col("atom").isin("CA", "C", "N", "O"), "sidechain": ~F.col("atom").isin("CA", "C", "N", "O") & ~hydrogen,
        }
        if word in fixed:
            return fixed[word]
        if word not in _FIELDS:
            raise ValueError(f"unknown word {word!r}")
        column = F.col(_FIELDS[word])
        if peek() in ("<", "<=", ">", ">=", "=", "!="):
            op, value = take(), float(take())
            return {"<": column < value, "<=": column <= value, ">": column > value, ">=": column >= value, "=": column == value, "!=": column != value}[op]
        values = re.split(r"[+,]", take().strip("\"'"))
        if word in ("resi", "index", "id"):
            tests = []
            for v in values:
                m = re.fullmatch(r"(-?\d+)(?:-(-?\d+))?", v)
                if not m:
                    raise ValueError(f"not a number: {v!r}")
                tests.append(column.between(int(m[1]), int(m[2])) if m[2] else column == int(m[1]))
            return reduce(lambda a, b: a | b, tests)
        if word == "elem":
            return F.upper(column).isin([v.upper() for v in values])
        if word == "alt":
            return F.coalesce(column, F.lit("")).isin([v.replace("''", "") for v in values])
        return column.isin(values)

    out = either()
    if at < len(words):
        raise ValueError(f"unexpected {words[at]!r} in {selection!r}")
    return out
