"""Topology: residues joined with components and links give restraint instances; hydrogens from bonded neighbours."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import angle, dist2
from ..storage import small


def bond_instances(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """Bonds of every residue: res_id, atoms' names, ideal, esd and the distance, from component bonds (comp_id, a, b, ideal, esd)."""
    one = atoms.select("res_id", F.col("resname").alias("comp_id"), F.col("name").alias("a"), F.struct("x", "y", "z").alias("_p"))
    two = atoms.select("res_id", F.col("name").alias("b"), F.struct("x", "y", "z").alias("_q"))
    j = one.join(bonds, ["comp_id", "a"]).join(two, ["res_id", "b"])
    d = F.sqrt(dist2(tuple(F.col(f"_p.{c}") for c in "xyz"), tuple(F.col(f"_q.{c}") for c in "xyz")))
    return j.select("res_id", "comp_id", "a", "b", "ideal", "esd", d.alias("value"))


def angle_instances(atoms: DataFrame, angles: DataFrame) -> DataFrame:
    """Angles of every residue in degrees, from component angles (comp_id, atom1, atom2, atom3, ideal, esd)."""
    p = lambda n, i: atoms.select("res_id", *([F.col("resname").alias("comp_id")] if i == 1 else []), F.col("name").alias(f"atom{i}"), F.struct("x", "y", "z").alias(f"_p{i}"))
    j = p("a", 1).join(angles, ["comp_id", "atom1"]).join(p("b", 2), ["res_id", "atom2"]).join(p("c", 3), ["res_id", "atom3"])
    v = [tuple(F.col(f"_p{i}.{c}") for c in "xyz") for i in (1, 2, 3)]
    return j.select("res_id", "comp_id", "atom1", "atom2", "atom3", "ideal", "esd", F.degrees(angle(*v)).alias("value"))


def link_instances(residues: DataFrame, max_bond: float = 2.0) -> DataFrame:
    """Peptide links of residues in sequence (c and n as structs): the pair's numbers and the distance, where it is a bond."""
    w = W.partitionBy("model", "chain").orderBy("res_ord")
    r = residues.withColumns({"_n": F.lead("n").over(w), "next_ord": F.lead("res_ord").over(w)})
    d = F.sqrt(dist2(tuple(F.col(f"c.{x}") for x in "xyz"), tuple(F.col(f"_n.{x}") for x in "xyz")))
    return r.withColumn("value", d).where(F.col("value") < max_bond).select("model", "chain", "res_ord", "next_ord", F.lit("TRANS").alias("link"), F.lit(1.336).alias("ideal"), F.lit(0.023).alias("esd"), "value")


def outliers(instances: DataFrame, cutoff: float = 2.0) -> DataFrame:
    """Instances whose |Z| passes the cutoff, the worst first."""
    z = (F.col("value") - F.col("ideal")) / F.col("esd")
    return instances.where("esd > 0").withColumn("z", z).where(F.abs("z") > cutoff).orderBy(F.desc(F.abs("z")))


def link_scores(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The best link of each pair of residues: links (link, comp_1, group_1, comp_2, group_2) score 2 for a component and 1 for a group on each side; an unmatched side rules a link out.

    The links are a library's few hundred rows, held against every pair.
    """
    side = lambda n: F.when(F.col(f"comp_{n}") == F.col(f"resname_{n}"), 2).when(F.col(f"comp_{n}").isNull() & (F.col(f"group_{n}") == F.col(f"resgroup_{n}")), 1).when(F.col(f"comp_{n}").isNull() & F.col(f"group_{n}").isNull(), 0)
    j = pairs.join(small(links)).withColumn("score", side(1) + side(2)).where("score is not null")
    return j.groupBy("pair_id").agg(F.max_by(F.struct("link", "score"), F.struct("score", "link")).alias("b")).select("pair_id", "b.*")


def placed_hydrogens(heavy: DataFrame) -> DataFrame:
    """Hydrogens on atoms (res_id, name, x, y, z, n_h, length, neighbours: array of structs x, y, z of bonded heavy atoms).

    Three neighbours: opposite their sum. Two: in plane for one hydrogen, above and below for two. One: staggered from an
    arbitrary normal at tetrahedral angles. Rows: res_id, name, number, x, y, z.
    """

    def run(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                p = np.array([r.x, r.y, r.z])
                u = [np.array([q["x"], q["y"], q["z"]]) - p for q in r.neighbours]
                u = [v / np.linalg.norm(v) for v in u]
                places: list[np.ndarray] = []
                if len(u) >= 3 and r.n_h == 1:
                    places = [-sum(u)]
                elif len(u) == 2:
                    middle, normal = -(u[0] + u[1]), np.cross(u[0], u[1])
                    middle, normal = middle / np.linalg.norm(middle), normal / np.linalg.norm(normal)
                    places = [middle] if r.n_h == 1 else [middle * np.cos(np.radians(54.75)) + s * normal * np.sin(np.radians(54.75)) for s in (1, -1)]
                elif len(u) == 1:
                    axis = u[0]
                    side = np.cross(axis, [1.0, 0, 0] if abs(axis[0]) < 0.9 else [0, 1.0, 0])
                    side /= np.linalg.norm(side)
                    other = np.cross(axis, side)
                    tilt = np.radians(70.53)
                    places = [-axis * np.cos(tilt) + np.sin(tilt) * (side * np.cos(2 * np.pi * i / r.n_h) + other * np.sin(2 * np.pi * i / r.n_h)) for i in range(r.n_h)]
                for i, v in enumerate(places):
                    out.append((r.res_id, r.name, i + 1, *(p + r.length * v / np.linalg.norm(v))))
            yield pd.DataFrame(out, columns=["res_id", "name", "number", "x", "y", "z"])

    kind = dict(heavy.dtypes)["res_id"]
    return heavy.mapInPandas(run, f"res_id {kind}, name string, number int, x double, y double, z double")
