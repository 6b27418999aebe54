"""Edits of CIF items and structures as plans, and lookups by address or interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import small
from .cif_query import BLOCK


def added_row(items: DataFrame, prefix: str, values: dict[str, str], at: int | None = None) -> DataFrame:
    """A row more in every loop that has the tags, at a place (the end by default); tags without a value are '?'."""
    low = prefix.lower()
    loop = items.where((F.col("kind") == "loop") & F.lower("tag").startswith(low))
    heads = loop.groupBy(*BLOCK, "frame", "item_idx", "kind", "category", "tag", "col_idx").agg((F.max("row_idx") + 1).alias("_n"))
    place = F.col("_n") if at is None else F.least(F.lit(at), F.col("_n"))
    given = F.create_map(*(F.lit(x) for k, v in values.items() for x in ((prefix + k).lower(), v))) if values else F.create_map().cast("map<string,string>")
    new = heads.select(*BLOCK, "frame", "item_idx", "kind", "category", "tag", "col_idx", place.cast("int").alias("row_idx"), F.coalesce(F.element_at(given, F.lower("tag")), F.lit("?")).alias("value_raw"))
    moved = items if at is None else items.withColumn("row_idx", F.when((F.col("kind") == "loop") & F.lower("tag").startswith(low) & (F.col("row_idx") >= at), F.col("row_idx") + 1).otherwise(F.col("row_idx")))
    return moved.unionByName(new, allowMissingColumns=True)


def without_rows(items: DataFrame, prefix: str, start: int, end: int) -> DataFrame:
    """Rows start to end (not included) of a loop removed, the later ones moved up."""
    inside = (F.col("kind") == "loop") & F.lower("tag").startswith(prefix.lower())
    kept = items.where(~F.coalesce(inside & (F.col("row_idx") >= start) & (F.col("row_idx") < end), F.lit(False)))
    return kept.withColumn("row_idx", F.when(inside & (F.col("row_idx") >= end), F.col("row_idx") - (end - start)).otherwise(F.col("row_idx")))


def moved_row(items: DataFrame, prefix: str, old: int, new: int) -> DataFrame:
    inside = (F.col("kind") == "loop") & F.lower("tag").startswith(prefix.lower())
    r = F.col("row_idx")
    shift = F.when(r == old, F.lit(new)).when((F.lit(old < new)) & (r > old) & (r <= new), r - 1).when((F.lit(new < old)) & (r >= new) & (r < old), r + 1).otherwise(r)
    return items.withColumn("row_idx", F.when(inside, shift).otherwise(r))


def added_column(items: DataFrame, prefix: str, name: str, value: str) -> DataFrame:
    """A column more at the end of every loop that has the prefix."""
    loop = items.where((F.col("kind") == "loop") & F.lower("tag").startswith(prefix.lower()))
    rows = loop.groupBy(*BLOCK, "frame", "item_idx", "kind", "category", "row_idx").agg((F.max("col_idx") + 1).alias("col_idx"))
    return items.unionByName(rows.withColumns({"tag": F.lit(prefix + name), "value_raw": F.lit(value)}), allowMissingColumns=True)


def sorted_loop(items: DataFrame, prefix: str, by: list[str]) -> DataFrame:
    """Rows of a loop in the order of columns' values, numbers as numbers."""
    from ..functions.values import cif_number

    inside = (F.col("kind") == "loop") & F.lower("tag").startswith(prefix.lower())
    keys = items.where(inside).groupBy(*BLOCK, "item_idx", "row_idx").agg(*(F.max(F.when(F.lower("tag") == (prefix + b).lower(), F.col("value_raw"))).alias(f"_k{i}") for i, b in enumerate(by)))
    order = [c for i in range(len(by)) for c in (cif_number(F.col(f"_k{i}")), F.col(f"_k{i}"))]
    new = keys.withColumn("_new", F.row_number().over(W.partitionBy(*BLOCK, "item_idx").orderBy(*order, "row_idx")) - 1).select(*BLOCK, "item_idx", "row_idx", "_new")
    return items.join(new, [*BLOCK, "item_idx", "row_idx"], "left").withColumn("row_idx", F.coalesce("_new", "row_idx")).drop("_new").select(items.columns)


def at_addresses(atoms: DataFrame, addresses: DataFrame) -> DataFrame:
    """Atoms at addresses (chain, seqnum, icode, resname, atom, altloc), with every column of the addresses; empty fields of altloc fit any."""
    keys = ["chain", "seqnum", "icode", "resname", "atom"]
    a = addresses.withColumnRenamed("altloc", "_altloc")
    return atoms.join(a, keys).where((F.coalesce("_altloc", F.lit("")) == "") | (F.col("_altloc") == F.coalesce("altloc", F.lit("")))).drop("_altloc")


def connection_lengths(connections: DataFrame, atoms: DataFrame, cell, group) -> DataFrame:
    """Distances of connections (conn_id, the two addresses with _1 and _2, stated): by the nearest image, where asu says so."""
    from .spatial import nearest_image

    keys = ["chain", "seqnum", "atom"]
    side = lambda n: atoms.select(*(F.col(k).alias(f"{k}_{n}") for k in keys), *(v.alias(f"f{c}_{n}") for v, c in zip(cell.fractional(F.col("x"), F.col("y"), F.col("z")), "xyz", strict=True)))
    j = connections.join(side(1), [f"{k}_1" for k in keys]).join(side(2), [f"{k}_2" for k in keys])
    return nearest_image(j, cell, group, ("fx_1", "fy_1", "fz_1"), ("fx_2", "fy_2", "fz_2")).drop(*(f"f{c}_{n}" for c in "xyz" for n in (1, 2)))


def tls_groups(residues: DataFrame, ranges: DataFrame) -> DataFrame:
    """Adds tls_group from ranges (chain, first, last, tls_group): an interval join on the chain."""
    r = ranges.select(F.col("chain").alias("_chain"), "first", "last", "tls_group")
    r = small(r)
    return residues.join(r, (residues["chain"] == F.col("_chain")) & residues["seqnum"].between(F.col("first"), F.col("last")), "left").drop("_chain", "first", "last")


def merged_chain_parts(residues: DataFrame, min_sep: int = 0) -> DataFrame:
    """Parts of a chain (part numbers its runs) in one row of numbers: each part's numbers start min_sep beyond the last where they would overlap."""
    parts = residues.groupBy("chain", "part").agg(F.min("seqnum").alias("_lo"), F.max("seqnum").alias("_hi"))
    w = W.partitionBy("chain").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    spans = parts.withColumn("_before", F.sum(F.col("_hi") - F.col("_lo") + 1 + min_sep).over(w))
    shift = F.when(F.col("_before").isNull() | (F.lit(min_sep) == 0), 0).otherwise(F.first("_lo").over(W.partitionBy("chain").orderBy("part")) + F.col("_before") - F.col("_lo"))
    return residues.join(spans.select("chain", "part", shift.alias("_shift")), ["chain", "part"]).withColumn("seqnum", (F.col("seqnum") + F.col("_shift")).cast("int")).drop("_shift", "part")


def label_numbers(aligned: DataFrame) -> DataFrame:
    """label_seq of a chain's residues from alignments (chain, cigar of the full sequence as query on the chain as target): chain, ord, label_seq."""
    runs = F.regexp_extract_all("cigar", F.lit(r"(\d+)([MID])"), 0)
    r = aligned.select("chain", F.posexplode(runs).alias("i", "run")).select("chain", "i", F.regexp_extract("run", r"(\d+)", 1).cast("int").alias("n"), F.regexp_extract("run", r"([MID])", 1).alias("op"))
    w = W.partitionBy("chain").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    r = r.withColumn("_q", F.coalesce(F.sum(F.when(F.col("op") != "D", F.col("n")).otherwise(0)).over(w), F.lit(0))).withColumn("_t", F.coalesce(F.sum(F.when(F.col("op") != "I", F.col("n")).otherwise(0)).over(w), F.lit(0)))
    m = r.where("op = 'M'").withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return m.select("chain", (F.col("_t") + F.col("_k")).cast("int").alias("ord"), (F.col("_q") + F.col("_k") + 1).cast("int").alias("label_seq"))


def iset_statistics(data: DataFrame, iset: str = "iset", frame: str = "frame") -> DataFrame:
    return data.groupBy(iset).agg(F.count("*").alias("n"), F.floor(F.min(frame)).alias("first"), F.ceil(F.max(frame)).alias("last"))


def original_indices(df: DataFrame, group) -> DataFrame:
    """h, k, l measured, from those of the asymmetric unit and ISYM: the inverse of the operation, negated for a Friedel mate."""
    from ..functions.symmetry import hkl_under

    choice: Column | None = None
    for n, o in reversed(list(enumerate(group.sym_ops, 1))):
        back = [v.cast("int") for v in hkl_under(o.inverse(), F.col("h"), F.col("k"), F.col("l"))]
        for sign, isym in ((-1, 2 * n), (1, 2 * n - 1)):
            row = F.struct(*((v * sign).alias(c) for v, c in zip(back, "hkl", strict=True)))
            test = F.when(F.col("isym") == isym, row)
            choice = test if choice is None else test.otherwise(choice)
    out = df.withColumn("_o", choice)
    return out.withColumns({c: F.col(f"_o.{c}") for c in "hkl"}).drop("_o")


def renamed_by_vote(atoms: DataFrame, aliases: DataFrame) -> DataFrame:
    """Old atom names replaced where they fit better: aliases (resname, old, new); a residue kind is renamed if more of its atoms have only old names than new ones."""
    kinds = atoms.select("resname", "atom").distinct()
    old = kinds.join(aliases, (kinds["resname"] == aliases["resname"]) & (kinds["atom"] == aliases["old"]), "left_semi").groupBy("resname").agg(F.count("*").alias("_old"))
    new = kinds.join(aliases, (kinds["resname"] == aliases["resname"]) & (kinds["atom"] == aliases["new"]), "left_semi").groupBy("resname").agg(F.count("*").alias("_new"))
    vote = old.join(new, "resname", "left").where(F.col("_old") > F.coalesce("_new", F.lit(0))).select("resname")
    use = aliases.join(vote, "resname").select("resname", F.col("old").alias("atom"), F.col("new").alias("_to"))
    return atoms.join(small(use), ["resname", "atom"], "left").withColumn("atom", F.coalesce("_to", "atom")).drop("_to").select(atoms.columns)


def good_size(n: int, factor: int = 1) -> int:
    """The least number from n that has only the primes 2, 3 and 5 and is a multiple of factor."""
    n = -(-n // factor) * factor
    while True:
        m = n
        for p in (2, 3, 5):
            while m % p == 0:
                m //= p
        if m == 1:
            return n
        n += factor


def map_size(cell, group, d_min: float, sample_rate: float = 3.0) -> tuple[int, int, int]:
    """Even grid sizes for a resolution, multiples of the group's factors, equal along axes that symmetry mixes."""
    from ..functions.symmetry import grid_factors

    factors = [f if f % 2 == 0 else 2 * f for f in grid_factors(group)]
    sizes = [good_size(max(1, -(-int(1000 * sample_rate * x / d_min) // 1000)), f) for x, f in zip((cell.a, cell.b, cell.c), factors, strict=True)]
    for o in group.sym_ops:
        for i in range(3):
            for j in range(3):
                if i != j and o.rot[i][j]:
                    sizes[i] = sizes[j] = max(sizes[i], sizes[j])
    return tuple(sizes)
