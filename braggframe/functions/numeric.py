"""Special functions, form factors and displacement tensors as Columns."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..storage import small


def _series(x: Column, coefficients: list[float]) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(c)
    return out


# The polynomial approximations of Abramowitz and Stegun, 9.8.1 to 9.8.4.
_I0_SMALL = [1.0, 3.5156229, 3.0899424, 1.2067492, 0.2659732, 0.0360768, 0.0045813]
_I0_LARGE = [0.39894228, 0.01328592, 0.00225319, -0.00157565, 0.00916281, -0.02057706, 0.02635537, -0.01647633, 0.00392377]
_I1_SMALL = [0.5, 0.87890594, 0.51498869, 0.15084934, 0.02658733, 0.00301532, 0.00032411]
_I1_LARGE = [0.39894228, -0.03988024, -0.00362018, 0.00163801, -0.01031555, 0.02282967, -0.02895312, 0.01787654, -0.00420059]


def log_bessel_i0(x: Column) -> Column:
    a = F.abs(x)
    t = (a / 3.75) * (a / 3.75)
    return F.when(a < 3.75, F.log(_series(t, _I0_SMALL))).otherwise(a - F.log(a) / 2 + F.log(_series(3.75 / a, _I0_LARGE)))


def bessel_i1_over_i0(x: Column) -> Column:
    """Odd, to about seven digits; 1 in the limit."""
    a = F.abs(x)
    t = (a / 3.75) * (a / 3.75)
    ratio = F.when(a < 3.75, a * _series(t, _I1_SMALL) / _series(t, _I0_SMALL)).otherwise(_series(3.75 / a, _I1_LARGE) / _series(3.75 / a, _I0_LARGE))
    return F.signum(x) * ratio


def log_cosh(x: Column) -> Column:
    """log(cosh(x)) without overflow."""
    a = F.abs(x)
    return a - F.log(F.lit(2.0)) + F.log1p(F.exp(-2 * a))


def figure_of_merit(centric: Column, x: Column) -> Column:
    """tanh(x) of centric reflections, I1/I0(x) of the others."""
    return F.when(centric, F.tanh(x)).otherwise(bessel_i1_over_i0(x))


def gaussian_form_factor(a: Column, b: Column, c: Column, stol2: Column) -> Column:
    """Sum of a exp(-b s2) and c; a and b are arrays."""
    return F.aggregate(F.arrays_zip(a.alias("a"), b.alias("b")), F.lit(0.0), lambda t, x: t + x["a"] * F.exp(-x["b"] * stol2)) + c


def mott_bethe(z: Column, f_xray: Column, stol2: Column) -> Column:
    """Electron scattering factor from the X-ray one; 0.023934 is me e2 / (8 pi eps0 h2) in these units, times 4 for stol2."""
    return 0.0239336609 * (z - f_xray) / stol2


def debye_waller(b_iso: Column, stol2: Column) -> Column:
    return F.exp(-b_iso * stol2)


def tls_tensor(t: list[Column], l: list[Column], s: list[list[Column]], x: Column, y: Column, z: Column) -> list[Column]:
    """U11, U22, U33, U12, U13, U23 of a rigid body: T, L (six each, degrees squared), S (3 x 3, degrees) at a place from the origin."""
    r = pi / 180
    L = [v * (r * r) for v in l]
    S = [[v * r for v in row] for row in s]
    l11, l22, l33, l12, l13, l23 = L
    return [
        t[0] + l22 * z * z + l33 * y * y - 2 * l23 * y * z + 2 * (S[1][0] * z - S[2][0] * y),
        t[1] + l11 * z * z + l33 * x * x - 2 * l13 * x * z + 2 * (S[2][1] * x - S[0][1] * z),
        t[2] + l11 * y * y + l22 * x * x - 2 * l12 * x * y + 2 * (S[0][2] * y - S[1][2] * x),
        t[3] - l33 * x * y + l23 * x * z + l13 * y * z - l12 * z * z - S[0][0] * z + S[1][1] * z + S[2][0] * x - S[2][1] * y,
        t[4] - l22 * x * z + l23 * x * y - l13 * y * y + l12 * y * z + S[0][0] * y - S[2][2] * y + S[1][2] * z - S[1][0] * x,
        t[5] - l11 * y * z - l23 * x * x + l13 * x * y + l12 * x * z - S[1][1] * x + S[2][2] * x + S[0][1] * y - S[0][2] * z,
    ]


def u_to_b(u: Column) -> Column:
    return 8 * pi * pi * u


def wrapped_degrees(x: Column) -> Column:
    return F.pmod(x, F.lit(360.0))


# Anomalous scattering needs tables of its own: bring them as a DataFrame (element, energy, fp, fpp) and look up here.
def interpolated_table(df, table, key: str, x: str, columns: list[str]):
    """Linear interpolation of a table's columns at x of each row, by key; null outside. The table is a dimension."""
    from pyspark.sql import Window as W

    w = W.partitionBy(key).orderBy(x)
    spans = table.select(key, F.col(x).alias("_x0"), F.lead(x).over(w).alias("_x1"), *(F.col(c).alias(f"_{c}0") for c in columns), *(F.lead(c).over(w).alias(f"_{c}1") for c in columns)).where("_x1 is not null")
    spans = spans.withColumnRenamed(key, "_key")
    spans = small(spans)
    j = df.join(spans, (df[key] == F.col("_key")) & (df[x] >= F.col("_x0")) & (df[x] < F.col("_x1")), "left")
    t = (F.col(x) - F.col("_x0")) / (F.col("_x1") - F.col("_x0"))
    out = j.select(*df.columns, *((F.col(f"_{c}0") + t * (F.col(f"_{c}1") - F.col(f"_{c}0"))).alias(c) for c in columns))
    return out
