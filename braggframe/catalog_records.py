"""Queries over PDB records, elements, displacement tensors and the operators beside them, each with its SQL.

Lines of PDB files are spelt from the supplied tables and read back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import _GRID, CELL, PTS, _grid, _loops, points, query, rounded, table
from .functions import elements
from .functions.values import hybrid36_text
from .operators import displacement, spatial
from .sources import pdb_records


def _spelt(df: DataFrame, pattern: str, *columns, path=None) -> DataFrame:
    """Lines of a file, or of those that path names, a row each."""
    return df.select((F.lit("f") if path is None else path).alias("path"), F.monotonically_increasing_id().alias("line_no"), F.format_string(pattern, *columns).alias("line"))


def _parts(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.withColumns({"chain": F.substring("p_brand", -1, 1), "res": F.upper(F.substring("p_type", 1, 3)), "n": (F.col("p_partkey") % 9999).cast("int"), "s": F.col("p_size").cast("int")})


def _part(spark, sf_dir) -> DataFrame:
    return _parts(spark, sf_dir).where("p_partkey < 100000")  # the columns of the format hold five digits


_PARTS = "(select *, right(p_brand, 1) as chain, upper(substr(p_type, 1, 3)) as res, cast(p_partkey % 9999 as int) as n, cast(p_size as int) as s from part)"
_PART = _PARTS.replace("from part", "from part where p_partkey < 100000")


@query(f"select p_partkey::int as serial, 'CA' as atom, res as resname, chain, n as seqnum, s * 10 as u11, s * 20 as u22, s * 30 as u33, -s as u12, s as u13, 0 as u23 from {_PART}")
def pdb_tensors(spark, sf_dir):
    c = F.col
    lines = _spelt(_part(spark, sf_dir), "ANISOU%5d  CA  %3s %1s%4d  %7d%7d%7d%7d%7d%7d", c("p_partkey"), "res", "chain", "n", c("s") * 10, c("s") * 20, c("s") * 30, -c("s"), c("s"), F.lit(0))
    return pdb_records.pdb_records(lines, "ANISOU").select("serial", "atom", "resname", "chain", "seqnum", "u11", "u22", "u33", "u12", "u13", "u23")


@query(f"select 'SG' as atom_1, res as resname_1, chain as chain_1, n as seqnum_1, 'ZN' as atom_2, 'ZN' as resname_2, 'Z' as chain_2, s as seqnum_2, '1555' as symop_1, s / 10 as length from {_PART}")
def pdb_links(spark, sf_dir):
    lines = _spelt(_part(spark, sf_dir), "LINK         SG  %3s %1s%4d                ZN    ZN Z%4d     1555   2655%6.2f", "res", "chain", "n", "s", F.col("s") / 10)
    return pdb_records.pdb_records(lines, "LINK").select("atom_1", "resname_1", "chain_1", "seqnum_1", "atom_2", "resname_2", "chain_2", "seqnum_2", "symop_1", "length")


@query(f"select s as number, res as resname_1, chain as chain_1, n as seqnum_1, 'PRO' as resname_2, 0 as model, s / 100 as angle from {_PART}")
def pdb_cis_peptides(spark, sf_dir):
    lines = _spelt(_part(spark, sf_dir), "CISPEP %3d %3s %1s %4d    PRO B    7        0      %6.2f", "s", "res", "chain", "n", F.col("s") / 100)
    return pdb_records.pdb_records(lines, "CISPEP").select("number", "resname_1", "chain_1", "seqnum_1", "resname_2", "model", "angle")


@query(f"select chain, n as first, n + s as last, 'UNP' as database, 'P' || p_partkey as accession, s as db_first from {_PARTS}")
def pdb_database_references(spark, sf_dir):
    """Accession codes beyond eight letters, and numbers beyond five digits, take two lines."""
    s, blank = F.col("s"), lambda x: F.coalesce(x, F.lit(""))
    chain, accession = blank(F.col("chain")), blank(F.concat(F.lit("P"), "p_partkey"))
    ends = chain, blank(F.col("n").cast("string")), blank(hybrid36_text(F.col("n") + s, 4))
    one = F.format_string("DBREF  1ABC %1s %4s  %4s  UNP    %-8s CODE         %5d  %5d", *ends, accession, s, s)
    two = F.format_string("DBREF1 1ABC %1s %4s  %4s  UNP                  CODE", *ends), F.format_string("DBREF2 1ABC %1s     %-22s     %10d  %10d", chain, accession, s, s)
    wide = (F.length(accession) > 8) | ~s.between(-9999, 99999)
    lines = _spelt(_parts(spark, sf_dir).select(F.explode(F.when(wide, F.array(*two)).otherwise(F.array(one))).alias("line")), "%s", "line")
    return pdb_records.database_references(lines).select(F.nullif("chain", F.lit("")).alias("chain"), "first", "last", "database", F.nullif("accession", F.lit("")).alias("accession"), "db_first")


_BLOCK = 40_000_000  # five columns of hybrid-36 hold the serial numbers of two blocks


@query(f"select a, b, count(*) as n from (select least(p_partkey, p_partkey + s)::int as a, greatest(p_partkey, p_partkey + s)::int as b from {_PARTS} union all select least(p_partkey, s)::int, greatest(p_partkey, s)::int from {_PARTS}) group by 1, 2")
def pdb_bonds(spark, sf_dir):
    """Atoms are numbered by blocks. A file has the bonds within a block or between two, its name the first numbers of both; serial numbers of the other block follow those of the first."""
    k, a, b = F.col("p_partkey").cast("long"), F.col("a"), F.col("b")
    bonds = _parts(spark, sf_dir).select(F.inline(F.array(*(F.struct(F.least(k, x).alias("a"), F.greatest(k, x).alias("b")) for x in (k + F.col("s"), F.col("s").cast("long"))))))
    at_a, at_b = (F.pmod(x, F.lit(_BLOCK)) for x in (a, b))
    behind = F.when(a - at_a < b - at_b, _BLOCK).otherwise(0)
    lines = _spelt(bonds, "CONECT%5s%5s", hybrid36_text(at_a, 5), hybrid36_text(at_b + behind, 5), path=F.concat_ws("_", a - at_a, b - at_b))
    start = lambda i: F.split("path", "_")[i].cast("long")
    second = F.when(b < _BLOCK, start(0)).otherwise(start(1) - _BLOCK)
    return pdb_records.bonded_pairs(pdb_records.pdb_records(lines, "CONECT")).select((a + start(0)).cast("int").alias("a"), (b + second).cast("int").alias("b"), "n")


@query("""select label, serial, round(x * 0.5 - y + 1.25, 5) as x, round(y + 0.125, 5) as y, round(z - 2, 5) as z from (select label, serial, x, y, z from """ + PTS + """) where label is not null""")
def ncs_copies(spark, sf_dir):
    rows = [(1, 0.5, -1.0, 0.0, 1.25), (2, 0.0, 1.0, 0.0, 0.125), (3, 0.0, 0.0, 1.0, -2.0)]
    m = spark.createDataFrame(rows, "i int, a double, b double, c double, t double")
    lines = _spelt(m, "MTRIX%1d   1%10.6f%10.6f%10.6f     %10.5f    1", "i", "a", "b", "c", "t")
    ops = pdb_records.operations(pdb_records.pdb_records(lines, "MTRIX"), given=True).drop("path").withColumn("chain", F.lit("A"))
    atoms = points(spark, sf_dir).where("label is not null").select("label", "serial", "x", "y", "z", F.lit("A").alias("chain"))
    return rounded(spatial.copied_by(atoms, ops).select("label", "serial", "x", "y", "z"), "x", "y", "z", places=5)


@query(f"select chain, string_agg(res, ' ' order by p_partkey) as names from {_PART} group by 1")
def pdb_sequences(spark, sf_dir):
    from pyspark.sql import Window as W

    p = _part(spark, sf_dir)
    at = F.row_number().over(W.partitionBy("chain").orderBy("p_partkey")) - 1
    rows = p.withColumn("_line", F.floor(at / 13).cast("int")).groupBy("chain", "_line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "res"))), lambda x: x["res"]), " ").alias("r"))
    lines = _spelt(rows, "SEQRES %3d %1s %4d  %s", F.col("_line") + 1, "chain", F.lit(1), "r")
    return pdb_records.sequences_of(pdb_records.pdb_records(lines, "SEQRES")).select("chain", F.array_join("names", " ").alias("names"))


@query("select p_partkey, case p_size % 5 when 0 then 26 when 1 then 6 when 2 then 34 when 3 then 92 end as number, case p_size % 5 when 0 then 55.845::double when 1 then 12.0107 when 2 then 78.96 when 3 then 238.029 end::double as weight, case p_size % 5 when 0 then 4 when 1 then 2 when 2 then 4 when 3 then 7 end as element_row, case p_size % 5 when 0 then 8 when 1 then 14 when 2 then 16 when 3 then 3 end as element_group, case p_size % 5 when 0 then true when 1 then false when 2 then false when 3 then true end as metal from part")
def element_facts(spark, sf_dir):
    s = F.get(F.array(*map(F.lit, ("Fe", "c", "SE", "U", "Xx"))), (F.col("p_size") % 5).cast("int"))
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", elements.atomic_number(s).alias("number"), elements.weight(s).alias("weight"), elements.row(s).alias("element_row"), elements.group(s).alias("element_group"), elements.metal(s).alias("metal"))


def _tensors(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    s = F.col("p_size")
    return p.select("p_partkey", (F.col("p_retailprice") / 20).alias("b_iso"), (F.col("p_partkey") % 37).cast("double").alias("x"), (F.col("p_partkey") % 41).cast("double").alias("y"), (F.col("p_partkey") % 43).cast("double").alias("z"), *(F.when(s > 10, s * k / 1000).alias(c) for c, k in zip(displacement.U, (10, 20, 30, 1, 2, 3), strict=True)))


_TEN = "(select p_partkey, p_retailprice / 20 as b_iso, cast(p_partkey % 37 as double) as x, cast(p_partkey % 41 as double) as y, cast(p_partkey % 43 as double) as z, case when p_size > 10 then p_size / 1000.0::double end as u from part)"


@query(f"select p_partkey, round(coalesce(10 * u, b_iso / (8 * pi() * pi())), 8) as u11, round(coalesce(30 * u, b_iso / (8 * pi() * pi())), 8) as u33, round(coalesce(u, 0), 8) as u12 from {_TEN}")
def tensors_made(spark, sf_dir):
    return rounded(displacement.with_tensors(_tensors(spark, sf_dir)).select("p_partkey", "u11", "u33", "u12"), "u11", "u33", "u12", places=8)


@query(f"select p_partkey, round(coalesce(8 * pi() * pi() * 20 * u, b_iso), 6) as b_iso from {_TEN}")
def tensors_to_b(spark, sf_dir):
    return rounded(displacement.without_tensors(_tensors(spark, sf_dir)).select("p_partkey", "b_iso"), "b_iso")


@query(f"select p_partkey, -y + 1 as x, x + 2 as y, z as z, round(20 * u, 8) as u11, round(10 * u, 8) as u22, round(30 * u, 8) as u33, round(-u, 8) as u12, round(-3 * u, 8) as u13, round(2 * u, 8) as u23 from {_TEN}")
def tensors_turned(spark, sf_dir):
    m = displacement.moved_with_tensors(_tensors(spark, sf_dir), [[0, -1, 0], [1, 0, 0], [0, 0, 1]], [1, 2, 0])
    return rounded(m.select("p_partkey", "x", "y", "z", *displacement.U), *displacement.U, places=8)


@query(f"select serial, round(2 * x + 38 * 0.25, 6) as x, round(2 * y, 6) as y, round(2 * z - 52 * 0.5, 6) as z from {PTS}")
def standard_frame(spark, sf_dir):
    scale = 2 * np.asarray(CELL.frac)
    return rounded(displacement.in_standard_frame(points(spark, sf_dir), CELL, scale, np.array([0.25, 0.0, -0.5])).select("serial", "x", "y", "z"), "x", "y", "z")


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 300000)")
def parents_with_children(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return displacement.with_children(table(spark, sf_dir, "customer").select("c_custkey"), orders, ["c_custkey"])


@query(f"""with p as (select 'u' as axis, u as pos, 16 as n from {_GRID} where u in (1, 2, 14) union select 'v', v, 16 from {_GRID} where u in (1, 2, 14) union select 'w', w, 16 from {_GRID} where u in (1, 2, 14)),
g as (select axis, n, pos, coalesce(lead(pos) over (partition by axis order by pos), min(pos) over (partition by axis) + n) as nx from p), b as (select *, row_number() over (partition by axis order by nx - pos desc, pos) as r from g)
select axis, cast(nx % n as int) as first, cast(nx % n + n - (nx - pos) as int) as last from b where r = 1""")
def grid_extent(spark, sf_dir):
    g = _grid(spark, sf_dir).withColumn("value", F.when(F.col("u").isin(1, 2, 14), F.col("value")).otherwise(0.0))
    return displacement.nonzero_extent(g, (16, 16, 16))


_QS = "[" + ", ".join(str(i / 20) for i in range(21)) + "]"


@query(f"""with a as (select quantile_cont(l_extendedprice, {_QS}) as q from lineitem where l_returnflag = 'A'), b as (select quantile_cont(l_extendedprice, {_QS}) as q from lineitem where l_returnflag = 'N')
select (i - 1) / 20.0::double as q, round(a.q[i], 4) as first, round(b.q[i], 4) as second from a, b, range(1, 22) t(i)""")
def quantiles_compared(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return rounded(displacement.quantile_pairs(li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'N'"), "l_extendedprice", 20), "first", "second", places=4)


@query("select l_linenumber, count(*) as n, round(avg(abs(l_quantity - m)) / any_value(m), 8) as rmad from (select *, avg(l_quantity) over (partition by l_linenumber) as m from lineitem) group by 1")
def relative_deviation(spark, sf_dir):
    return rounded(displacement.relative_deviation(table(spark, sf_dir, "lineitem"), ["l_linenumber"], "l_quantity"), "rmad", places=8)


@query("""select 'f' || (o % 10) as path, cast(o as bigint) as block_idx, case o % 4 when 0 then 'one.dic' when 1 then 'one.dic' when 2 then 'two.dic' end as dict_name, case o % 4 when 0 then '1.10' when 1 then '1.' || (o % 20) when 2 then '3' end as dict_version,
case when o % 4 = 3 then 'unstated' when o % 4 = 2 then 'unknown' when o % 4 = 0 or o % 20 = 10 then 'same' when o % 20 < 10 then 'older' else 'newer' end as status from (select distinct l_orderkey as o from lineitem)""")
def dictionaries_conform(spark, sf_dir):
    items = _loops(spark, sf_dir, True)
    k = F.col("block_idx")
    name = F.when(k % 4 <= 1, "one.dic").when(k % 4 == 2, "two.dic")
    version = F.when(k % 4 == 0, "1.10").when(k % 4 == 1, F.concat(F.lit("1."), (k % 20).cast("string"))).when(k % 4 == 2, "3")
    blocks = items.select("path", "block_idx", "block").distinct()
    tags = F.inline(F.array(*(F.struct(F.lit(i).alias("col_idx"), F.lit(f"_audit_conform.{t}").alias("tag"), v.alias("value_raw")) for i, (t, v) in enumerate((("dict_name", name), ("dict_version", version))))))
    audit = blocks.select("path", "block_idx", "block", F.lit(None).cast("string").alias("frame"), F.lit(9).alias("item_idx"), F.lit("pair").alias("kind"), F.lit("audit_conform").alias("category"), F.lit(0).alias("row_idx"), F.lit(1).alias("line_no"), tags)
    known = spark.createDataFrame([("one.dic", "1.10")], "dict_name string, dict_version string")
    return displacement.conforms(items.unionByName(audit), known)
