"""More queries of the structural engine on the supplied tables, each with its SQL: edits of CIF items, edits of models, cells,
restraints and whole analyses. Views are those of the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import _GRID, ATM, CELL, HKL, PTS, _grid, _loops, atoms, hkls, points, query, rounded, table
from .functions import numeric, values
from .functions.cell import Cell
from .functions.geometry import angle, angle_difference, chiral_volume
from .functions.symmetry import spacegroup
from .operators import chemistry, cif_query, editing, grid, model, reflections, spatial, structure, topology
from .plans import composite

_P = "P 21 21 21"
TRICLINIC = Cell(30.0, 40.0, 50.0, 80.0, 95.0, 110.0)

# One row for each order and line number, as _loops(..., True) has them.
_LINES = "(select l_orderkey as o, l_linenumber as n, max(l_quantity) as q, max(l_returnflag) as f, max(l_shipdate) as d from lineitem group by 1, 2)"
_LOOP = f"""(select 'f' || (o % 10) as path, cast(o as bigint) as block_idx, cast(n - 1 as int) as row_idx, cast(unnest([0, 1, 2, 3]) as int) as col_idx, unnest(['_line.id', '_line.quantity', '_line.flag', '_line.ship']) as tag,
 unnest([cast(n as varchar), cast(cast(q as int) as varchar), case f when 'N' then '?' else f end, strftime(d, '%Y-%m-%d')]) as value_raw from {_LINES})"""
_CELLS = ["block_idx", "row_idx", "col_idx", "tag", "value_raw"]


@query(f"select block_idx, row_idx, value_raw from {_LOOP} where tag = '_line.quantity'")
def find_column(spark, sf_dir):
    return cif_query.find_values(_loops(spark, sf_dir, True), "_LINE.Quantity").select("block_idx", "row_idx", "value_raw")


@query(f"select block_idx, min(value_raw) as value_raw from {_LOOP} where tag = '_line.id' group by 1 having max(row_idx) = 0")
def find_single_value(spark, sf_dir):
    return cif_query.find_value(_loops(spark, sf_dir, True), "_line.id").select("block_idx", "value_raw")


@query(f"select cast(o as bigint) as block_idx, cast(n - 1 as int) as row_idx, cast(n as varchar) as id, case f when 'N' then '?' else f end as flag, cast(null as varchar) as nothing from {_LINES}")
def read_category(spark, sf_dir):
    return cif_query.category(_loops(spark, sf_dir, True), "_line.", ["id", "flag", "nothing"]).select("block_idx", "row_idx", "id", "flag", "nothing")


@query(f"select distinct block_idx, 'line' as category, 0 as item_idx from {_LOOP}")
def category_catalogue(spark, sf_dir):
    return cif_query.category_names(_loops(spark, sf_dir, True)).select("block_idx", "category", "item_idx")


@query(f"""select block_idx, case when row_idx >= 1 then row_idx + 1 else row_idx end as row_idx, col_idx, tag, value_raw from {_LOOP}
union all select block_idx, least(1, max(row_idx) + 1), col_idx, tag, case tag when '_line.id' then '99' else '?' end from {_LOOP} group by block_idx, col_idx, tag""")
def row_inserted(spark, sf_dir):
    return editing.added_row(_loops(spark, sf_dir, True), "_line.", {"id": "99"}, 1).select(*_CELLS)


@query(f"select block_idx, row_idx, col_idx, tag, value_raw from {_LOOP} union all select block_idx, cast(max(row_idx) + 1 as int), col_idx, tag, case tag when '_line.flag' then 'X' else '?' end from {_LOOP} group by block_idx, col_idx, tag")
def row_appended(spark, sf_dir):
    return editing.added_row(_loops(spark, sf_dir, True), "_line.", {"flag": "X"}).select(*_CELLS)


@query(f"select block_idx, case when row_idx >= 3 then row_idx - 2 else row_idx end as row_idx, col_idx, tag, value_raw from {_LOOP} where row_idx not in (1, 2)")
def rows_removed(spark, sf_dir):
    return editing.without_rows(_loops(spark, sf_dir, True), "_line.", 1, 3).select(*_CELLS)


@query(f"select block_idx, case when row_idx = 0 then 2 when row_idx in (1, 2) then row_idx - 1 else row_idx end as row_idx, col_idx, tag, value_raw from {_LOOP}")
def row_moved(spark, sf_dir):
    return editing.moved_row(_loops(spark, sf_dir, True), "_line.", 0, 2).select(*_CELLS)


@query(f"select block_idx, row_idx, col_idx, tag, value_raw from {_LOOP} union all select distinct block_idx, row_idx, 4, '_line.note', 'new' from {_LOOP}")
def column_added(spark, sf_dir):
    return editing.added_column(_loops(spark, sf_dir, True), "_line.", "note", "new").select(*_CELLS)


@query(f"select distinct block_idx, 1 as item_idx, '_note.text' as tag, 'checked' as value_raw from {_LOOP}")
def pair_set(spark, sf_dir):
    return cif_query.with_pair(_loops(spark, sf_dir, True), "_note.text", "checked").where("kind = 'pair'").select("block_idx", "item_idx", "tag", "value_raw")


@query(f"select tag, count(*) as n from {_LOOP} where tag not like '\\_line.q%' escape '\\' group by 1")
def column_erased(spark, sf_dir):
    return cif_query.without(_loops(spark, sf_dir, True), "_line.Q").groupBy("tag").agg(F.count("*").alias("n"))


@query(f"select distinct block_idx, '_line.id' as tag, 2 as n from {_LOOP} where row_idx > 2")
def duplicate_tags(spark, sf_dir):
    items = _loops(spark, sf_dir, True)
    again = items.where("tag = '_line.id' and row_idx > 2").withColumns({"item_idx": F.lit(1), "tag": F.lit("_LINE.id")})
    return cif_query.duplicates(items.unionByName(again)).select("block_idx", "tag", F.col("n").cast("int").alias("n"))


@query(f"select cast(o as bigint) as block_idx, cast(row_number() over (partition by o order by cast(q as int), n) - 1 as int) as row_idx, cast(n as varchar) as id from {_LINES}")
def loop_sorted(spark, sf_dir):
    s = editing.sorted_loop(_loops(spark, sf_dir, True), "_line.", ["quantity"]).where("tag = '_line.id'")
    return s.select("block_idx", "row_idx", F.col("value_raw").alias("id"))


@query(f"select path, count(*) filter (cast(n as int) <> cast(q as int)) as id__quantity from (select 'f' || (o % 10) as path, n, q from {_LINES}) group by 1")
def columns_differ(spark, sf_dir):
    return composite.columns_that_differ(_loops(spark, sf_dir, True), "line", [("id", "quantity")])


@query("select distinct 'f' || (l_orderkey % 10) as path, 'weight' as missing, false as in_order from lineitem")
def column_order(spark, sf_dir):
    c = composite.column_order(_loops(spark, sf_dir, True).where("row_idx = 0").dropDuplicates(["path", "tag"]), "line", ["id", "flag", "quantity", "weight"])
    return c.select("path", F.array_join("missing", " ").alias("missing"), "in_order")


def _entities(spark, sf_dir) -> DataFrame:
    """Line items as sequences: an order is a block, a line's status its entity and its flag a monomer; entity F is a protein."""
    li = _loops(spark, sf_dir, True).where("tag = '_line.flag'")
    status = F.when(F.col("block_idx") % 3 == 0, "1").otherwise("2")
    tags = lambda *rows: F.inline(F.array(*(F.struct(F.lit(i).alias("col_idx"), F.lit(t).alias("tag"), v.alias("value_raw")) for i, (t, v) in enumerate(rows))))
    base = ["path", "block_idx", "block", "frame", "kind", "line_no"]
    seq = li.select(*base, F.lit(0).alias("item_idx"), F.lit("entity_poly_seq").alias("category"), "row_idx", tags(("_entity_poly_seq.entity_id", status), ("_entity_poly_seq.mon_id", F.col("value_raw"))))
    poly = li.where("row_idx = 0").select(*base, F.lit(1).alias("item_idx"), F.lit("entity_poly").alias("category"), F.lit(0).alias("row_idx"), tags(("_entity_poly.entity_id", F.lit("1")), ("_entity_poly.type", F.lit("'polypeptide(L)'"))))
    return seq.unionByName(poly)


@query(f"select 'f' || (o % 10) as path, case f when 'N' then '' else f end as mon_id, count(*) as n from {_LINES} where o % 3 = 0 and o in (select o from {_LINES} where n = 1) group by 1, 2")
def residue_frequency(spark, sf_dir):
    return composite.residue_frequency(_entities(spark, sf_dir)).select("path", F.coalesce("mon_id", F.lit("")).alias("mon_id"), "n")


@query("""select o_orderkey, case when regexp_matches(s, '^[_#$''"\\[\\];]|\\s|^$') then '''' || s || '''' else s end as written from (select o_orderkey, case when o_orderkey % 3 = 0 then '_' || o_orderstatus when o_orderkey % 3 = 1 then o_orderpriority else o_orderstatus end as s from orders)""")
def values_quoted(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    s = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("_"), "o_orderstatus")).when(F.col("o_orderkey") % 3 == 1, F.col("o_orderpriority")).otherwise(F.col("o_orderstatus"))
    return o.select("o_orderkey", values.cif_quoted(s).alias("written"))


@query("select c_custkey, 'structures/divided/mmCIF/' || substr(c, 2, 2) || '/' || c || '.cif.gz' as place, 'structures/divided/structure_factors/' || substr(c, 2, 2) || '/r' || c || 'sf.ent.gz' as data from (select c_custkey, lower(right('0000' || c_custkey, 4)) as c from customer)")
def archive_places(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.lpad(F.substring(F.col("c_custkey").cast("string"), -4, 4), 4, "0").alias("c"))
    return c.select("c_custkey", values.archive_path(F.col("c")).alias("place"), values.archive_path(F.col("c"), "S").alias("data"))


# Models.


@query(f"select serial from {ATM} where element <> 'N'")
def without_hydrogens(spark, sf_dir):
    a = atoms(spark, sf_dir).withColumn("element", F.when(F.col("element") == "N", F.when(F.col("serial") % 2 == 0, "D").otherwise("h")).otherwise(F.col("element")))
    return model.without_hydrogens(a).select("serial")


def _residues(spark, sf_dir) -> DataFrame:
    return atoms(spark, sf_dir).groupBy("model", "chain", "res_ord", "seqnum").agg(F.min("resname").alias("resname"))


_RES = f"(select model, chain, res_ord, seqnum, min(resname) as resname from {ATM} group by 1, 2, 3, 4)"


@query(f"select chain, seqnum, lag(seqnum) over w as prev_seqnum, lag(resname) over w as prev_resname, lead(seqnum) over w as next_seqnum, lead(resname) over w as next_resname from {_RES} window w as (partition by model, chain order by res_ord)")
def residues_beside(spark, sf_dir):
    return model.neighbours_in_sequence(_residues(spark, sf_dir)).select("chain", "seqnum", "prev_seqnum", "prev_resname", "next_seqnum", "next_resname")


@query(f"select chain, string_agg(case resname when 'PRO' then 'P' else '(' || resname || ')' end, '' order by res_ord) as sequence from {_RES} group by model, chain")
def chain_sequences(spark, sf_dir):
    return model.sequences(_residues(spark, sf_dir)).select("chain", "sequence")


@query(f"select serial, -y + 1.5 as x, x - 2.0 as y, z + 0.25 as z from {ATM}")
def atoms_turned(spark, sf_dir):
    return model.transformed_atoms(atoms(spark, sf_dir), [[0, -1, 0], [1, 0, 0], [0, 0, 1]], [1.5, -2.0, 0.25]).select("serial", "x", "y", "z")


@query(f"select serial, case chain when '1' then 'A' when '2' then 'B' else chain end as chain from {ATM}")
def chains_renamed(spark, sf_dir):
    return model.renamed(atoms(spark, sf_dir), "chain", {"1": "A", "2": "B"}).select("serial", "chain")


@query(f"select serial, chain || case when occ > 0.5 then 'X' else 'Y' end as chain from {ATM}")
def split_by_segment(spark, sf_dir):
    return structure.split_by_segment(atoms(spark, sf_dir).withColumn("segment", F.when(F.col("occ") > 0.5, "X").otherwise("Y"))).select("serial", "chain")


def _hydrogens(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part").where("p_partkey > 1")
    name = F.when(F.col("p_partkey") % 2 == 0, "H").otherwise("D")
    return p.select(F.lit(1).alias("model"), F.lit("A").alias("chain"), F.floor(F.col("p_partkey") / 2).cast("int").alias("res_ord"), F.concat(name, F.lit("1")).alias("atom"), name.alias("element"), (F.col("p_size") / 50).alias("occ"), F.lit("").alias("altloc"), F.col("p_partkey").alias("atom_ord"))


_HYD = "(select cast(p_partkey // 2 as int) as res_ord, round(sum(p_size / 50), 6) as occ, round(sum(case when p_partkey % 2 = 1 then p_size / 50 else 0 end) / sum(p_size / 50), 6) as d_fraction from part where p_partkey > 1 group by 1)"


@query(f"select res_ord, 'H1' as atom, occ, d_fraction from {_HYD}")
def deuterium_fractions(spark, sf_dir):
    return rounded(structure.deuterium_as_fraction(_hydrogens(spark, sf_dir)).select("res_ord", "atom", "occ", "d_fraction"), "occ", "d_fraction")


@query(f"""select res_ord, 'H1' as atom, 'H' as element, case when d_fraction > 0 and d_fraction < 1 then 'A' else '' end as altloc, round(occ * (1 - d_fraction), 4) as occ from {_HYD} where d_fraction < 1
union all select res_ord, 'D1', 'D', case when d_fraction > 0 and d_fraction < 1 then 'D' else '' end, round(occ * d_fraction, 4) from {_HYD} where d_fraction > 0""")
def deuterium_locations(spark, sf_dir):
    a = structure.deuterium_as_altlocs(structure.deuterium_as_fraction(_hydrogens(spark, sf_dir)))
    return rounded(a.select("res_ord", "atom", "element", "altloc", "occ"), "occ", places=4)


@query("""with r as (select right(p_brand, 1) as chain, cast(p_partkey as int) as label_seq, case when p_size > 30 then cast(p_size as int) end as off from part)
select chain, label_seq, label_seq + coalesce(last_value(off ignore nulls) over (partition by chain order by label_seq rows between unbounded preceding and current row), first_value(off ignore nulls) over (partition by chain order by label_seq rows between current row and unbounded following)) as seqnum from r""")
def label_to_auth(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.substring("p_brand", -1, 1).alias("chain"), F.col("p_partkey").cast("int").alias("label_seq"), "p_size")
    known = p.where("p_size > 30").select("chain", "label_seq", (F.col("label_seq") + F.col("p_size")).cast("int").alias("seqnum"))
    return structure.label_to_auth(known, p.select("chain", "label_seq"))


@query("""with a as (select cast(p_partkey as varchar) as chain, cast(p_size % 5 + 1 as int) as a, cast(p_size % 3 + 1 as int) as b from part)
select chain, cast(k as int) as ord, cast(k + 1 as int) as label_seq from (select chain, unnest(range(0, a)) as k from a) union all select chain, cast(a + k as int), cast(a + b + k + 1 as int) from (select *, unnest(range(0, 4)) as k from a)
union all select chain, cast(a + 6 + k as int), cast(a + b + 4 + k + 1 as int) from (select *, unnest(range(0, 3)) as k from a)""")
def label_numbers(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    cigar = F.concat((F.col("p_size") % 5 + 1).cast("string"), F.lit("M"), (F.col("p_size") % 3 + 1).cast("string"), F.lit("I4M2D3M"))
    return editing.label_numbers(p.select(F.col("p_partkey").cast("string").alias("chain"), cigar.alias("cigar")))


@query(f"select a.serial as serial, b.serial as of from {ATM} a join {ATM} b using (chain, seqnum, icode, resname, atom) where b.occ > 0.7 and (b.altloc = '' or b.altloc = a.altloc)")
def at_addresses(spark, sf_dir):
    a = atoms(spark, sf_dir)
    addresses = a.where("occ > 0.7").select("chain", "seqnum", "icode", "resname", "atom", "altloc", F.col("serial").alias("of"))
    return editing.at_addresses(a, addresses).select("serial", "of")


@query(f"select serial, case when chain = '1' and seqnum between 5 and 90 then 1 when chain = '2' and seqnum between 100 and 400 then 2 end as tls_group from {ATM}")
def tls_groups(spark, sf_dir):
    ranges = spark.createDataFrame([("1", 5, 90, 1), ("2", 100, 400, 2)], "chain string, first int, last int, tls_group int")
    return editing.tls_groups(atoms(spark, sf_dir), ranges).select("serial", "tls_group")


@query(f"""select serial, chain || 'a' as chain, x, y, z from {ATM} where chain in ('1', '2') union all select serial, chain || 'b', y + 1, z - 2, x + 0.5 from {ATM} where chain = '1'""")
def assembly_copies(spark, sf_dir):
    names = ["chain", "op_name", *(f"r{i}{k}" for i in (1, 2, 3) for k in (1, 2, 3)), "t1", "t2", "t3"]
    same, turned = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0), (0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 1.0, -2.0, 0.5)
    ops = spark.createDataFrame([("1", "a", *same), ("2", "a", *same), ("1", "b", *turned)], names)
    return spatial.copied_by(atoms(spark, sf_dir), ops).select("serial", "chain", "x", "y", "z")


@query(f"select serial, round(38 * (x / 38 - floor(x / 38)), 6) as x, round(44 * (y / 44 - floor(y / 44)), 6) as y, round(52 * (z / 52 - floor(z / 52)), 6) as z from {PTS}")
def moved_into_cell(spark, sf_dir):
    return rounded(spatial.in_cell(points(spark, sf_dir), CELL).select("serial", "x", "y", "z"), "x", "y", "z")


@query(f"""with f as (select serial, x / 38 as x, y / 44 as y, z / 52 as z from {PTS}), i as (select serial, unnest([1, 2, 3, 4]) as image, unnest([{{'a': x, 'b': y, 'c': z}}, {{'a': -x, 'b': y + .5, 'c': .5 - z}}, {{'a': .5 - x, 'b': -y, 'c': z + .5}}, {{'a': x + .5, 'b': .5 - y, 'c': -z}}]) as m from f),
g as (select m.a - floor(m.a) as a, m.b - floor(m.b) as b, m.c - floor(m.c) as c from i)
select count(*) as copies from g, range(-1, 2) u(i), range(-1, 2) v(j), range(-1, 2) w(k) where a + i between -3 / 38.0 and 1 + 3 / 38.0 and b + j between -3 / 44.0 and 1 + 3 / 44.0 and c + k between -3 / 52.0 and 1 + 3 / 52.0""")
def images_about_cell(spark, sf_dir):
    return spatial.crystal_images(points(spark, sf_dir), CELL, spacegroup(_P), 3.0).agg(F.count("*").alias("copies"))


@query(f"select h, k, l, count(*) as n from {HKL} group by 1, 2, 3")
def original_indices(spark, sf_dir):
    a = spacegroup(_P).to_asu(F.col("h"), F.col("k"), F.col("l"))
    inside = hkls(spark, sf_dir).select(a.alias("a")).select(*(F.col(f"a.{c}").alias(c) for c in "hkl"), F.col("a.isym").alias("isym"))
    return editing.original_indices(inside, spacegroup(_P)).groupBy("h", "k", "l").agg(F.count("*").alias("n"))


@query(f"select k as h, -h as k, l, value from {HKL}")
def reindexed(spark, sf_dir):
    from .functions.symmetry import parse_triplet

    return reflections.reindexed(hkls(spark, sf_dir), parse_triplet("k,-h,l")).select("h", "k", "l", "value")


@query("select l_linenumber as iset, count(*) as n, cast(floor(min(l_extendedprice / 1000)) as bigint) as first, cast(ceil(max(l_extendedprice / 1000)) as bigint) as last from lineitem group by 1")
def iset_statistics(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("iset"), (F.col("l_extendedprice") / 1000).alias("frame"))
    return editing.iset_statistics(li)


@query("select k, x, row_number() over (order by x) - 1 as rank from (select cast(min(l_orderkey) as bigint) as k, l_extendedprice as x from lineitem group by 2)")
def exact_order(spark, sf_dir):
    """Ranks of all different prices, with another column kept."""
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_extendedprice").alias("x")).agg(F.min("l_orderkey").alias("k"))
    return reflections.exact_ranks(x, "x").select("k", "x", F.col("_rank").alias("rank"))


# Cells and geometry.

_CA, _CB, _CG = ("cos(radians(80.0))", "cos(radians(95.0))", "cos(radians(110.0))")
_V = f"sqrt(1 - pow({_CA}, 2) - pow({_CB}, 2) - pow({_CG}, 2) + 2 * {_CA} * {_CB} * {_CG})"
_SG = "sin(radians(110.0))"


@query(f"""select serial, round((x - y * {_CG} / {_SG} + z * ({_CA} * {_CG} - {_CB}) / ({_V} * {_SG})) / 30, 8) as fx, round((y / {_SG} + z * ({_CB} * {_CG} - {_CA}) / ({_V} * {_SG})) / 40, 8) as fy, round(z * {_SG} / ({_V} * 50), 8) as fz from {PTS}""")
def fractional_triclinic(spark, sf_dir):
    f = TRICLINIC.fractional(F.col("x"), F.col("y"), F.col("z"))
    return points(spark, sf_dir).select("serial", *(F.round(v, 8).alias(f"f{c}") for v, c in zip(f, "xyz", strict=True)))


@query(f"""select serial, round(30 * x + 40 * {_CG} * y + 50 * {_CB} * z, 6) as x, round(40 * {_SG} * y + 50 * ({_CA} - {_CB} * {_CG}) / {_SG} * z, 6) as y, round(50 * {_V} / {_SG} * z, 6) as z from {PTS}""")
def orthogonal_triclinic(spark, sf_dir):
    o = TRICLINIC.orthogonalized(F.col("x"), F.col("y"), F.col("z"))
    return points(spark, sf_dir).select("serial", *(F.round(v, 6).alias(c) for v, c in zip(o, "xyz", strict=True)))


@query(f"""with u as (select distinct h, k, l from {HKL} where h <> 0 or k <> 0 or l <> 0), s as (select *, (pow(h * sin(radians(80.0)) / 30, 2) + pow(k * sin(radians(95.0)) / 40, 2) + pow(l * {_SG} / 50, 2) + 2 * h * k * ({_CA} * {_CB} - {_CG}) / (30 * 40)
 + 2 * k * l * ({_CB} * {_CG} - {_CA}) / (40 * 50) + 2 * h * l * ({_CA} * {_CG} - {_CB}) / (30 * 50)) / pow({_V}, 2) as s from u) select h, k, l, round(s, 8) as inv_d2, round(1 / sqrt(s), 6) as d, round(s / 4, 8) as stol2 from s""")
def resolution_triclinic(spark, sf_dir):
    h, k, l = map(F.col, "hkl")
    u = hkls(spark, sf_dir).select("h", "k", "l").distinct().where("h <> 0 or k <> 0 or l <> 0")
    return u.select("h", "k", "l", F.round(TRICLINIC.inv_d2(h, k, l), 8).alias("inv_d2"), F.round(TRICLINIC.d(h, k, l), 6).alias("d"), F.round(TRICLINIC.stol2(h, k, l), 8).alias("stol2"))


_POLAR = "(select p_partkey, cast(p_partkey % 37 as double) + 1 as x, cast(p_partkey % 41 as double) + 2 as y, cast(p_partkey % 43 as double) + 3 as z from part)"


@query(f"""select p_partkey, round(degrees(acos((x * y + y * z + z * x) / (x * x + y * y + z * z))), 6) as angle, round(x * (z * y - x * x) - y * (y * y - x * z) + z * (y * x - z * z), 3) as chirality from {_POLAR}""")
def angles_and_chirality(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    x, y, z = ((F.col("p_partkey") % n).cast("double") + i for i, n in ((1, 37), (2, 41), (3, 43)))
    o = (F.lit(0.0),) * 3
    return p.select("p_partkey", F.round(F.degrees(angle((x, y, z), o, (y, z, x))), 6).alias("angle"), F.round(chiral_volume(o, (x, y, z), (y, z, x), (z, x, y)), 3).alias("chirality"))


@query("select o_orderkey, round(o_totalprice - 360 * floor(o_totalprice / 360), 6) as wrapped, round(least(m, 360 - m), 6) as apart from (select o_orderkey, o_totalprice, abs(o_totalprice - o_custkey) - 360 * floor(abs(o_totalprice - o_custkey) / 360) as m from orders)")
def angles_wrapped(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.round(numeric.wrapped_degrees(F.col("o_totalprice")), 6).alias("wrapped"), F.round(F.abs(angle_difference(F.col("o_totalprice"), F.col("o_custkey").cast("double"))), 6).alias("apart"))


@query("select l_orderkey, l_linenumber, round(2 * exp(-l_quantity * l_tax) + 3 * exp(-0.5 * l_tax) + 0.25, 8) as f, round(0.0239336609 * (6 - l_quantity) / (l_tax + 0.01), 8) as electron, round(8 * pi() * pi() * l_tax, 6) as b from lineitem")
def form_factors(spark, sf_dir):
    li, s = table(spark, sf_dir, "lineitem"), F.col("l_tax")
    f = numeric.gaussian_form_factor(F.array(F.lit(2.0), F.lit(3.0)), F.array(F.col("l_quantity"), F.lit(0.5)), F.lit(0.25), s)
    return li.select("l_orderkey", "l_linenumber", F.round(f, 8).alias("f"), F.round(numeric.mott_bethe(F.lit(6.0), F.col("l_quantity"), s + 0.01), 8).alias("electron"), F.round(numeric.u_to_b(s), 6).alias("b"))


_R2 = "pow(pi() / 180, 2)"


@query(f"select serial, round(0.1 + 2 * {_R2} * z * z + 3 * {_R2} * y * y - 2 * 0.3 * {_R2} * y * z, 8) as u11, round(0.2 + 1 * {_R2} * z * z + 3 * {_R2} * x * x - 2 * 0.2 * {_R2} * x * z, 8) as u22, round(0.01 - 3 * {_R2} * x * y + 0.3 * {_R2} * x * z + 0.2 * {_R2} * y * z - 0.1 * {_R2} * z * z, 8) as u12 from {PTS}")
def tls_tensors(spark, sf_dir):
    lit = lambda xs: [F.lit(x) for x in xs]
    u = numeric.tls_tensor(lit([0.1, 0.2, 0.3, 0.01, 0.02, 0.03]), lit([1.0, 2.0, 3.0, 0.1, 0.2, 0.3]), [lit([0.0] * 3)] * 3, F.col("x"), F.col("y"), F.col("z"))
    return points(spark, sf_dir).select("serial", F.round(u[0], 8).alias("u11"), F.round(u[1], 8).alias("u22"), F.round(u[3], 8).alias("u12"))


# Grids.


@query(f"with p as (select serial, ((floor(x / 38 * 16 + .5)::int % 16 + 16) % 16)::int as u, ((floor(y / 44 * 16 + .5)::int % 16 + 16) % 16)::int as v, ((floor(z / 52 * 16 + .5)::int % 16 + 16) % 16)::int as w from {PTS}) select serial, value from p left join {_GRID} using (u, v, w)")
def grid_nearest(spark, sf_dir):
    f = CELL.fractional(F.col("x"), F.col("y"), F.col("z"))
    p = points(spark, sf_dir).select("serial", *(v.alias(f"f{c}") for v, c in zip(f, "xyz", strict=True)))
    return grid.nearest_values(p, _grid(spark, sf_dir), (16, 16, 16)).select("serial", "value")


@query(f"""select cast(a.i as int) as u, cast(b.j as int) as v, cast(c.k as int) as w, sum(case when g.u = a.i * 2 and g.v = b.j * 2 and g.w = c.k then value else 0 end) as value from range(8) a(i), range(8) b(j), range(16) c(k) join {_GRID} g
on g.u in (a.i * 2, a.i * 2 + 1) and g.v in (b.j * 2, b.j * 2 + 1) and g.w in (c.k, (c.k + 1) % 16) group by 1, 2, 3""")
def grid_resampled(spark, sf_dir):
    return grid.resampled(_grid(spark, sf_dir), (16, 16, 16), (8, 8, 16))


# Chemistry.


@query("select p_partkey, round(12.0107::double * p_size + 14.0067::double * (p_size % 7 + 1) + 15.9994::double, 4) as calculated from part where abs(12.0107 * p_size + 14.0067 * (p_size % 7 + 1) + 15.9994 - p_retailprice / 2) > 50")
def formula_check(spark, sf_dir):
    e = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("C"), "p_size", F.lit(" N"), F.col("p_size") % 7 + 1, F.lit(" O")).alias("formula"), (F.col("p_retailprice") / 2).alias("weight"))
    return rounded(composite.formula_check(e, 50.0).select("p_partkey", "calculated"), "calculated", places=4)


@query(f"select chain, round((max(x) - min(x)) / 38, 6) as extent_x, round((max(y) - min(y)) / 44, 6) as extent_y, round((max(z) - min(z)) / 52, 6) as extent_z from {ATM} group by 1 having greatest((max(x) - min(x)) / 38, (max(y) - min(y)) / 44, (max(z) - min(z)) / 52) > 0.5")
def long_chains(spark, sf_dir):
    c = composite.long_chains(atoms(spark, sf_dir).withColumn("path", F.lit("p")), CELL, 0.5)
    return rounded(c.select("chain", "extent_x", "extent_y", "extent_z"), "extent_x", "extent_y", "extent_z")


def _named(spark, sf_dir) -> DataFrame:
    a = atoms(spark, sf_dir)
    return a.groupBy(F.concat_ws(":", "chain", F.col("seqnum").cast("string"), "resname").alias("res_id"), "resname", F.col("atom").alias("name")).agg(*(F.min(c).alias(c) for c in "xyz"))


_NAMED = f"(select chain || ':' || seqnum || ':' || resname as res_id, resname, atom as name, min(x) as x, min(y) as y, min(z) as z from {ATM} group by 1, 2, 3)"


@query(f"with r as (select distinct res_id, resname from {_NAMED}) select r.res_id as res_id, n.name as name from r, (values ('N'), ('CA'), ('C'), ('O')) n(name) where r.resname in ('PRO', 'ECO') and not exists (select 1 from {_NAMED} a where a.res_id = r.res_id and a.name = n.name)")
def missing_atoms(spark, sf_dir):
    expected = spark.createDataFrame([(r, n) for r in ("PRO", "ECO") for n in ("N", "CA", "C", "O")], "resname string, name string")
    return chemistry.missing_atoms(expected, _named(spark, sf_dir)).select("res_id", "name")


def _joined(spark, sf_dir) -> DataFrame:
    """One residue a chain and name: every kind of atom once."""
    a = atoms(spark, sf_dir)
    return a.groupBy(F.concat_ws(":", "chain", "resname").alias("res_id"), "resname", F.col("atom").alias("name")).agg(*(F.min_by(c, "serial").alias(c) for c in "xyz"))


_JOINED = f"(select chain || ':' || resname as res_id, resname, atom as name, min_by(x, serial) as x, min_by(y, serial) as y, min_by(z, serial) as z from {ATM} group by 1, 2, 3)"
_BOND = f"(select a.res_id as res_id, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) as value from {_JOINED} a join {_JOINED} b on a.res_id = b.res_id and a.name = 'N' and b.name = 'CA' where a.resname = 'PRO')"


@query(f"select res_id, round(value, 6) as value, round((value - 10) / 3, 6) as z from {_BOND}")
def bond_instances(spark, sf_dir):
    bonds = spark.createDataFrame([("PRO", "N", "CA", 10.0, 3.0)], "comp_id string, a string, b string, ideal double, esd double")
    b = topology.bond_instances(_joined(spark, sf_dir), bonds)
    return b.select("res_id", F.round("value", 6).alias("value"), F.round((F.col("value") - F.col("ideal")) / F.col("esd"), 6).alias("z"))


@query(f"select res_id, 'bond' as kind, round(value, 6) as value from {_BOND} union all select a.res_id, 'angle', round(degrees(acos(((a.x - b.x) * (c.x - b.x) + (a.y - b.y) * (c.y - b.y) + (a.z - b.z) * (c.z - b.z)) / sqrt((pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) * (pow(c.x - b.x, 2) + pow(c.y - b.y, 2) + pow(c.z - b.z, 2))))), 4) from {_JOINED} a join {_JOINED} b using (res_id) join {_JOINED} c using (res_id) where a.name = 'N' and b.name = 'CA' and c.name = 'C' and a.resname = 'PRO'")
def restraint_values(spark, sf_dir):
    a = _joined(spark, sf_dir)
    kinds = [("bond", "N", "CA", None, None, 10.0), ("angle", "N", "CA", "C", None, 90.0)]
    r = spark.createDataFrame(kinds, "kind string, atom1 string, atom2 string, atom3 string, atom4 string, ideal double").withColumn("period", F.lit(None).cast("int"))
    each = a.where("resname = 'PRO'").select("res_id").distinct().crossJoin(F.broadcast(r))  # two restraints a residue
    v = chemistry.restraint_values(each, a).where("value is not null")
    return v.select("res_id", "kind", F.when(F.col("kind") == "bond", F.round("value", 6)).otherwise(F.round("value", 4)).alias("value"))


@query("select c, f, v from (select n_nationkey as c, n_name as f, n_regionkey as v from nation where n_nationkey not in (3, 5) union all select 5, 'CHANGED', 9 union all select 99, 'ADDED', 1)")
def restraints_modified(spark, sf_dir):
    r = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c"), F.col("n_name").alias("f"), F.col("n_regionkey").alias("v"))
    changes = spark.createDataFrame([(3, None, None, "delete"), (5, "CHANGED", 9, "change"), (99, "ADDED", 1, "add")], "c int, f string, v int, function string")
    return chemistry.modified(r, changes, ["c"])
