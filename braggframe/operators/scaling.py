"""Scaling of calculated to observed amplitudes: normal equations in one aggregate, solved on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def least_squares(df: DataFrame, terms: list[Column], y: Column, weight: Column | None = None) -> np.ndarray:
    """Coefficients of the linear least squares of y on terms: n (n + 1) / 2 + n sums, whatever the rows."""
    w = weight if weight is not None else F.lit(1.0)
    n = len(terms)
    sums = [F.sum(w * terms[i] * terms[j]).alias(f"a{i}_{j}") for i in range(n) for j in range(i, n)] + [F.sum(w * terms[i] * y).alias(f"b{i}") for i in range(n)]
    r = df.agg(*sums).first()
    a = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            a[i, j] = a[j, i] = r[f"a{i}_{j}"] or 0.0
    return np.linalg.lstsq(a, np.array([r[f"b{i}"] or 0.0 for i in range(n)]), rcond=None)[0]


def anisotropic_scale(df: DataFrame, fo: str, fc: str, terms: dict[str, Column]) -> dict[str, float]:
    """ln(Fo / Fc) = ln k - 1/4 sum of B terms (for instance h h, k k, l l and the mixed ones times reciprocal edges): k and the B's."""
    ok = df.where((F.col(fo) > 1) & (F.col(fc) > 0))
    x = least_squares(ok, [F.lit(1.0), *(t * -0.25 for t in terms.values())], F.log(F.col(fo) / F.col(fc)))
    return {"k": float(np.exp(x[0]))} | dict(zip(terms, map(float, x[1:]), strict=True))


def bulk_solvent_scale(df: DataFrame, fo: str, stol2: Column, start: tuple[float, float, float, float] = (1.0, 0.0, 0.35, 46.0), rounds: int = 12) -> dict[str, float]:
    """k, B, k_sol, b_sol of k exp(-B s2) |Fc + k_sol exp(-b_sol s2) Fm| against Fo, by Levenberg and Marquardt.

    Rows have fc_re, fc_im, fm_re, fm_im. Every round is one aggregate of the normal equations' sums.
    """
    p, lam = np.array(start, float), 1e-3
    base = df.where(F.col(fo) > 0).withColumn("_s", stol2)

    def parts(q: np.ndarray) -> tuple[Column, list[Column]]:
        k, b, ks, bs = (float(v) for v in q)
        e, m = F.exp(-b * F.col("_s")), F.exp(-bs * F.col("_s"))
        re, im = F.col("fc_re") + ks * m * F.col("fm_re"), F.col("fc_im") + ks * m * F.col("fm_im")
        amp = F.sqrt(re * re + im * im)
        model = k * e * amp
        along = F.when(amp > 0, (re * F.col("fm_re") + im * F.col("fm_im")) / amp).otherwise(0.0)
        return model, [e * amp, -F.col("_s") * model, k * e * along * m, -k * e * along * ks * m * F.col("_s")]

    def cost(q: np.ndarray) -> float:
        model, _ = parts(q)
        return base.agg(F.sum((F.col(fo) - model) * (F.col(fo) - model))).first()[0] or 0.0

    now = cost(p)
    for _ in range(rounds):
        model, jac = parts(p)
        sums = [F.sum(jac[i] * jac[j]).alias(f"a{i}_{j}") for i in range(4) for j in range(i, 4)] + [F.sum(jac[i] * (F.col(fo) - model)).alias(f"b{i}") for i in range(4)]
        r = base.agg(*sums).first()
        a = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(4)] for i in range(4)])
        g = np.array([r[f"b{i}"] or 0.0 for i in range(4)])
        step = np.linalg.lstsq(a + lam * np.diag(np.diag(a) + 1e-12), g, rcond=None)[0]
        then = cost(p + step)
        if then < now:
            better = (now - then) / max(now, 1e-300)
            p, now, lam = p + step, then, lam / 10
            if better < 1e-8:
                break
        else:
            lam *= 10
    return dict(zip(("k", "b", "k_sol", "b_sol"), map(float, p), strict=True))
