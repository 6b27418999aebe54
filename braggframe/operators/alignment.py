"""Sequence alignment, superposition, planes: grouped Arrow UDFs, a pair or group of points at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import small

NEG = -(10**9)


def align(query: str, target: str, match: int = 1, mismatch: int = -1, gap_open: int = -1, gap_extend: int = -1, target_gap_open: list[int] | None = None) -> tuple[int, str]:
    """Global alignment with affine gaps: score and CIGAR (M, I: in the query only, D: in the target only).

    A gap of n costs gap_open + n * gap_extend. target_gap_open gives the opening of gaps before each target position
    and after the last. Rows are numpy vectors along the target; only the gaps inside a row are sequential.
    """
    n, m = len(query), len(target)
    opens = np.array(target_gap_open if target_gap_open is not None else [gap_open] * (m + 1))
    q, t = np.frombuffer(query.encode("utf-32-le"), np.uint32), np.frombuffer(target.encode("utf-32-le"), np.uint32)
    h = np.full((n + 1, m + 1), NEG)
    e, f = h.copy(), h.copy()
    h[0, 0] = 0
    for j in range(1, m + 1):
        e[0, j] = gap_open + gap_extend * j
        h[0, j] = e[0, j]
    for i in range(1, n + 1):
        f[i] = np.maximum(h[i - 1] + opens, f[i - 1]) + gap_extend
        h[i, 0] = f[i, 0]
        diagonal = h[i - 1, :-1] + np.where(t == q[i - 1], match, mismatch)
        base = np.maximum(diagonal, f[i, 1:])
        best = h[i, 0]
        run = NEG
        for j in range(m):
            run = max(best + gap_open, run) + gap_extend
            e[i, j + 1] = run
            best = h[i, j + 1] = max(base[j], run)
    ops, i, j, state = [], n, m, "h"
    while i or j:
        if state == "h":
            if i and j and h[i, j] == h[i - 1, j - 1] + (match if q[i - 1] == t[j - 1] else mismatch):
                ops.append("M")
                i, j = i - 1, j - 1
                continue
            state = "f" if i and h[i, j] == f[i, j] else "e"
        if state == "f":
            ops.append("I")
            if f[i, j] == h[i - 1, j] + opens[j] + gap_extend:
                state = "h"
            i -= 1
        else:
            ops.append("D")
            if e[i, j] == h[i, j - 1] + gap_open + gap_extend:
                state = "h"
            j -= 1
    out, last, count = [], None, 0
    for o in [*reversed(ops), None]:
        if o != last and last:
            out.append(f"{count}{last}")
            count = 0
        last, count = o, count + 1
    return int(h[n, m]), "".join(out)


def align_pairs(pairs: DataFrame, query: str, target: str, **scoring: int) -> DataFrame:
    """Adds score, cigar and identity to a table of string pairs, row by row."""

    def run(frames):
        for pdf in frames:
            rows = [align(a or "", b or "", **scoring) for a, b in zip(pdf[query], pdf[target], strict=True)]
            same = [sum_matches(a or "", b or "", c) for (a, b), (_, c) in zip(zip(pdf[query], pdf[target], strict=True), rows, strict=True)]
            yield pdf.assign(score=[r[0] for r in rows], cigar=[r[1] for r in rows], identity=same)

    types = ", ".join(f"`{c}` {t}" for c, t in pairs.dtypes)
    return pairs.mapInPandas(run, f"{types}, score long, cigar string, identity double")


def sum_matches(a: str, b: str, cigar: str) -> float:
    """Share of the shorter sequence that is matched by equal letters."""
    import re

    i = j = n = 0
    for k, o in re.findall(r"(\d+)([MID])", cigar):
        k = int(k)
        if o == "M":
            n += sum(x == y for x, y in zip(a[i : i + k], b[j : j + k], strict=True))
        i += k if o != "D" else 0
        j += k if o != "I" else 0
    return n / min(len(a), len(b)) if a and b else 0.0


def best_sequences(chains: DataFrame, sequences: DataFrame, **scoring: int) -> DataFrame:
    """For each chain (chain_id, seq) the sequence (seq_id, full) of the highest score. The sequences are the small side: those of one query file."""
    pairs = chains.crossJoin(small(sequences.distinct()))
    scored = align_pairs(pairs, "full", "seq", **scoring)
    return scored.groupBy("chain_id").agg(F.max_by(F.struct("seq_id", "score", "identity"), F.struct("score", "identity")).alias("b")).select("chain_id", "b.*")


def superpose(fixed: np.ndarray, moving: np.ndarray, weights: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """RMSD, rotation and shift that bring moving onto fixed, from the largest eigenvector of the quaternion matrix."""
    w = np.ones(len(fixed)) if weights is None else weights
    cf, cm = (w[:, None] * fixed).sum(0) / w.sum(), (w[:, None] * moving).sum(0) / w.sum()
    a, b = fixed - cf, moving - cm
    s = (w[:, None] * b).T @ a
    k = np.array([
        [s[0, 0] + s[1, 1] + s[2, 2], s[1, 2] - s[2, 1], s[2, 0] - s[0, 2], s[0, 1] - s[1, 0]],
        [0, s[0, 0] - s[1, 1] - s[2, 2], s[0, 1] + s[1, 0], s[2, 0] + s[0, 2]],
        [0, 0, -s[0, 0] + s[1, 1] - s[2, 2], s[1, 2] + s[2, 1]],
        [0, 0, 0, -s[0, 0] - s[1, 1] + s[2, 2]],
    ])
    values, vectors = np.linalg.eigh(k + np.triu(k, 1).T)
    q0, q1, q2, q3 = vectors[:, -1]
    rot = np.array([
        [q0 * q0 + q1 * q1 - q2 * q2 - q3 * q3, 2 * (q1 * q2 - q0 * q3), 2 * (q1 * q3 + q0 * q2)],
        [2 * (q1 * q2 + q0 * q3), q0 * q0 - q1 * q1 + q2 * q2 - q3 * q3, 2 * (q2 * q3 - q0 * q1)],
        [2 * (q1 * q3 - q0 * q2), 2 * (q2 * q3 + q0 * q1), q0 * q0 - q1 * q1 - q2 * q2 + q3 * q3],
    ])
    norm = (w * (a * a).sum(1)).sum() + (w * (b * b).sum(1)).sum() - 2 * values[-1]
    return float(np.sqrt(max(0.0, norm) / w.sum())), rot, cf - rot @ cm


def superposed(pairs: DataFrame, keys: list[str], trim_cycles: int = 0, trim_cutoff: float = 2.0) -> DataFrame:
    """Per group of matched points x, y, z and x_2, y_2, z_2: n, rmsd, rotation (9 numbers) and shift. Trimming drops pairs beyond cutoff times the rmsd."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[["x", "y", "z"]].to_numpy(float), pdf[["x_2", "y_2", "z_2"]].to_numpy(float)
        rmsd, rot, tran = superpose(a, b)
        for _ in range(trim_cycles):
            d = np.linalg.norm(a - (b @ rot.T + tran), axis=1)
            keep = d <= trim_cutoff * rmsd
            if keep.all() or keep.sum() < 3:
                break
            a, b = a[keep], b[keep]
            rmsd, rot, tran = superpose(a, b)
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "n": len(a), "rmsd": rmsd, "rotation": rot.ravel().tolist(), "shift": tran.tolist()}])

    types = ", ".join(f"`{k}` {dict(pairs.dtypes)[k]}" for k in keys)
    return pairs.groupBy(*keys).applyInPandas(run, f"{types}, n long, rmsd double, rotation array<double>, shift array<double>")


def moments(df: DataFrame, keys: list[str], xyz: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """Count, centroid and second central moments of points: partial sums only."""
    x, y, z = xyz
    pairs = [(x, x), (y, y), (z, z), (x, y), (x, z), (y, z)]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m_{c}") for c in xyz), *(F.covar_pop(a, b).alias(f"s_{a}{b}") for a, b in pairs))


def best_planes(df: DataFrame, keys: list[str]) -> DataFrame:
    """Plane of least squares of each group: unit normal, offset, smallest eigenvalue; the eigenproblem runs on one row a group."""
    m = moments(df, keys)

    def run(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                s = np.array([[r.s_xx, r.s_xy, r.s_xz], [r.s_xy, r.s_yy, r.s_yz], [r.s_xz, r.s_yz, r.s_zz]])
                values, vectors = np.linalg.eigh(s)
                normal = vectors[:, 0] * (1 if vectors[np.argmax(np.abs(vectors[:, 0])), 0] >= 0 else -1)
                out.append((normal.tolist(), float(-normal @ [r.m_x, r.m_y, r.m_z]), float(values[0])))
            yield pdf[[*keys, "n"]].assign(normal=[o[0] for o in out], offset=[o[1] for o in out], least=[o[2] for o in out])

    types = ", ".join(f"`{k}` {t}" for k, t in m.dtypes if k in keys)
    return m.mapInPandas(run, f"{types}{', ' if keys else ''}n long, normal array<double>, offset double, least double")
