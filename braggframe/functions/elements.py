"""Elements: number, symbol, weight, and what follows from the number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Symbols in the order of atomic numbers, with standard atomic weights.
TABLE = """H 1.00794 He 4.0026 Li 6.941 Be 9.012182 B 10.811 C 12.0107 N 14.0067 O 15.9994 F 18.998403 Ne 20.1797 Na 22.98977 Mg 24.305 Al 26.981539 Si 28.0855 P 30.973761 S 32.065 Cl 35.453 Ar 39.948
K 39.0983 Ca 40.078 Sc 44.95591 Ti 47.867 V 50.9415 Cr 51.9961 Mn 54.93805 Fe 55.845 Co 58.9332 Ni 58.6934 Cu 63.546 Zn 65.38 Ga 69.723 Ge 72.64 As 74.9216 Se 78.96 Br 79.904 Kr 83.798
Rb 85.4678 Sr 87.62 Y 88.90585 Zr 91.224 Nb 92.9064 Mo 95.95 Tc 98 Ru 101.07 Rh 102.9055 Pd 106.42 Ag 107.8682 Cd 112.411 In 114.818 Sn 118.71 Sb 121.76 Te 127.6 I 126.90447 Xe 131.293
Cs 132.905 Ba 137.327 La 138.905 Ce 140.116 Pr 140.908 Nd 144.24 Pm 145 Sm 150.36 Eu 151.964 Gd 157.25 Tb 158.925 Dy 162.5 Ho 164.93 Er 167.259 Tm 168.934 Yb 173.05 Lu 174.967
Hf 178.49 Ta 180.948 W 183.84 Re 186.207 Os 190.23 Ir 192.217 Pt 195.084 Au 196.967 Hg 200.59 Tl 204.383 Pb 207.2 Bi 208.98 Po 209 At 210 Rn 222
Fr 223 Ra 226 Ac 227 Th 232.038 Pa 231.036 U 238.029 Np 237 Pu 244 Am 243 Cm 247 Bk 247 Cf 251 Es 252 Fm 257 Md 258 No 259 Lr 262
Rf 267 Db 268 Sg 271 Bh 272 Hs 270 Mt 276 Ds 281 Rg 280 Cn 285 Nh 284 Fl 289 Mc 288 Lv 293 Ts 294 Og 294""".split()
SYMBOLS = [s.upper() for s in TABLE[::2]]
WEIGHTS = dict(zip(SYMBOLS, map(float, TABLE[1::2]), strict=True)) | {"D": 2.0141}
NUMBERS = {s: i for i, s in enumerate(SYMBOLS, 1)} | {"D": 1}
#: Number of the noble gas that ends each row.
_ENDS = (2, 10, 18, 36, 54, 86, 118)
#: The last element of each of rows 2 to 7 that is a metal.
_METALS = {2: 4, 3: 13, 4: 31, 5: 50, 6: 83, 7: 118}


def row_of(number: int) -> int:
    return next(i for i, end in enumerate(_ENDS, 1) if number <= end)


def group_of(number: int) -> int:
    """1 to 18; lanthanides and actinides, which have none of their own, 3."""
    row = row_of(number)
    place, length = number - ((0, *_ENDS)[row - 1]), _ENDS[row - 1] - (0, *_ENDS)[row - 1]
    if place <= 2 and number != 2:
        return place
    return max(3, 18 - (length - place))


def is_metal(number: int) -> bool:
    row = row_of(number)
    return row > 1 and number <= _METALS[row] and number > _ENDS[row - 2]


def _looked_up(symbol: Column, values: dict, kind: str) -> Column:
    return F.element_at(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.lit(v).cast(kind)))), F.upper(symbol))


def atomic_number(symbol: Column) -> Column:
    """Of a symbol in any case; null if there is no such element."""
    return _looked_up(symbol, NUMBERS, "int")


def weight(symbol: Column) -> Column:
    return _looked_up(symbol, WEIGHTS, "double")


def row(symbol: Column) -> Column:
    return _looked_up(symbol, {s: row_of(n) for s, n in NUMBERS.items()}, "int")


def group(symbol: Column) -> Column:
    return _looked_up(symbol, {s: group_of(n) for s, n in NUMBERS.items()}, "int")


def metal(symbol: Column) -> Column:
    return _looked_up(symbol, {s: is_metal(n) for s, n in NUMBERS.items()}, "boolean")
