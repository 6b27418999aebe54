"""Queries of the structural engine on the supplied tables, each with its SQL.

The tables are no crystals, so each query first views one as what its operator takes: line items as unmerged
intensities (part, supplier and line number make h, k and l), embeddings as atoms, JSON keys of events as tags.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import numeric, values
from .functions.cell import Cell
from .functions.geometry import dihedral
from .functions.symmetry import spacegroup
from .operators import alignment, chemistry, cif_query, grid, model, reflections, scaling, selection, spatial, structure, topology
from .plans import composite
from .session import ship_package
from .sources import crystallography
from .streaming import merging

CELL = Cell(38.0, 44.0, 52.0)
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        _queries[name or f.__name__] = f
        if sql is not None:
            _sql[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# Views and their SQL.


def observations(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    i = lambda c, n: (F.col(c) % n).cast("int")
    return li.select(i("l_partkey", 50).alias("h"), i("l_suppkey", 20).alias("k"), F.col("l_linenumber").cast("int").alias("l"), F.lit(1).alias("isign"), (F.col("l_extendedprice") / 1000).alias("value"), (F.col("l_quantity") / 10 + 1).alias("sigma"), F.round(F.col("l_discount") * 100).cast("int").alias("shell"))


OBS = "(select cast(l_partkey % 50 as int) h, cast(l_suppkey % 20 as int) k, cast(l_linenumber as int) l, 1 isign, l_extendedprice / 1000 as value, l_quantity / 10 + 1 as sigma, cast(round(l_discount * 100) as int) shell from lineitem)"


def hkls(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    i = lambda c, n, s: (F.col(c) % n - s).cast("int")
    return li.select(i("l_partkey", 21, 10).alias("h"), i("l_suppkey", 21, 10).alias("k"), (F.col("l_linenumber") - 4).cast("int").alias("l"), (F.col("l_extendedprice") / 1000).alias("value"), (F.col("l_quantity") / 10 + 1).alias("sigma"))


HKL = "(select cast(l_partkey % 21 - 10 as int) h, cast(l_suppkey % 21 - 10 as int) k, cast(l_linenumber - 4 as int) l, l_extendedprice / 1000 as value, l_quantity / 10 + 1 as sigma from lineitem)"


def points(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    c = lambda i: F.get("embedding", F.lit(i)).cast("double") * 40
    return e.select(F.col("vec_id").alias("serial"), c(0).alias("x"), c(1).alias("y"), c(2).alias("z"), F.lit(1.0).alias("occ"), F.col("label"))


PTS = "(select vec_id as serial, cast(embedding[1] as double) * 40 x, cast(embedding[2] as double) * 40 y, cast(embedding[3] as double) * 40 z, 1.0::double as occ, label from embeddings)"


def atoms(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.lit(1).alias("model"), F.substring("p_brand", -1, 1).alias("chain"), (F.col("p_partkey") % 500).cast("int").alias("seqnum"), F.lit("").alias("icode"), F.upper(F.substring("p_type", 1, 3)).alias("resname"),
        F.when(F.col("p_size") % 4 == 0, "CA").when(F.col("p_size") % 4 == 1, "N").when(F.col("p_size") % 4 == 2, "C").otherwise("O").alias("atom"), F.when(F.col("p_size") % 10 == 0, "A").otherwise("").alias("altloc"),
        F.when(F.col("p_size") % 4 == 1, "N").when(F.col("p_size") % 4 == 3, "O").otherwise("C").alias("element"), (F.col("p_size") / 50).alias("occ"), (F.col("p_retailprice") / 20).alias("b_iso"), F.col("p_partkey").alias("serial"),
        F.lit("ATOM").alias("group_pdb"), (F.col("p_partkey") % 500).cast("int").alias("res_ord"), F.col("p_partkey").cast("int").alias("atom_ord"), (F.col("p_partkey") % 37).cast("double").alias("x"), (F.col("p_partkey") % 41).cast("double").alias("y"), (F.col("p_partkey") % 43).cast("double").alias("z"),
    )


ATM = """(select 1 as model, right(p_brand, 1) as chain, cast(p_partkey % 500 as int) seqnum, '' as icode, upper(substr(p_type, 1, 3)) resname,
 case p_size % 4 when 0 then 'CA' when 1 then 'N' when 2 then 'C' else 'O' end as atom, case when p_size % 10 = 0 then 'A' else '' end altloc,
 case p_size % 4 when 1 then 'N' when 3 then 'O' else 'C' end as element, p_size / 50 as occ, p_retailprice / 20 as b_iso, p_partkey as serial,
 cast(p_partkey % 500 as int) res_ord, cast(p_partkey as int) atom_ord, cast(p_partkey % 37 as double) x, cast(p_partkey % 41 as double) y, cast(p_partkey % 43 as double) z from part)"""

KEYS = ["h", "k", "l", "isign"]


@query(f"""select h, k, l, isign, round(sum(value / (sigma * sigma)) / sum(1 / (sigma * sigma)), 6) as value, round(1 / sqrt(sum(1 / (sigma * sigma))), 6) as sigma, count(*) as nobs
from {OBS} group by h, k, l, isign""")
def merge_mean(spark, sf_dir):
    return rounded(reflections.merged(observations(spark, sf_dir), KEYS), "value", "sigma")


def _stats_sql(weights: str, by: str = "shell") -> str:
    w = "1.0" if weights == "U" else "1 / (sigma * sigma)"
    below = "n * mean" if weights == "Y" else "sum_i"
    return f"""with o as (select *, {w} as w from {OBS} where sigma > 0),
m as (select shell, h, k, l, isign, sum(w * value) / sum(w) as mean, sum(w * value * value) / sum(w) as mean_sq, count(*) as n, sum(value) as sum_i from o group by 1, 2, 3, 4, 5),
g as (select m.*, d.dev from m join (select o.shell, o.h, o.k, o.l, o.isign, sum(abs(value - mean)) as dev from o join m on o.shell = m.shell and o.h = m.h and o.k = m.k and o.l = m.l and o.isign = m.isign group by 1, 2, 3, 4, 5) d
 on d.shell = m.shell and d.h = m.h and d.k = m.k and d.l = m.l and d.isign = m.isign),
s as (select {by} as shell, sum(n) as all_refl, count(*) as unique_refl, count(*) filter (n > 1) as ns, sum(dev) filter (n > 1) as a, sum(dev * sqrt(n / (n - 1.0))) filter (n > 1) as b, sum(dev * sqrt(1 / (n - 1.0))) filter (n > 1) as c,
 sum({below}) filter (n > 1) as den, sum(mean) filter (n > 1) as m1, sum(mean * mean) filter (n > 1) as m2, sum(2 * (mean_sq - mean * mean) / (n - 1)) filter (n > 1) as e from g group by {by})
select shell, cast(all_refl as bigint) as all_refl, unique_refl, ns as stats_refl, round(a / den, 6) as r_merge, round(b / den, 6) as r_meas, round(c / den, 6) as r_pim,
 round(((m2 - m1 * m1 / ns) / (ns - 1) - e / ns / 2) / ((m2 - m1 * m1 / ns) / (ns - 1) + e / ns / 2), 6) as cc_half from s"""


def _stats(weights: str):
    def run(spark, sf_dir):
        sums = reflections.merging_sums(observations(spark, sf_dir), KEYS, "shell", weights)
        return rounded(reflections.merging_statistics(sums).drop("cc_star"), "r_merge", "r_meas", "r_pim", "cc_half")

    return run


for _w in "YUX":
    query(_stats_sql(_w), f"merge_stats_{_w.lower()}")(_stats(_w))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queries["merge_stats_y"](spark, sf_dir)


@query(f"""with s as ({_stats_sql("U")}) select round(sum(r_merge * stats_refl) / sum(stats_refl), 5) as r_merge, cast(sum(all_refl) as bigint) as all_refl from s""")
def merge_stats_average(spark, sf_dir):
    s = reflections.merging_statistics(reflections.merging_sums(observations(spark, sf_dir), KEYS, "shell", "U"))
    return s.agg(F.round(reflections.take_average(s, "r_merge"), 5).alias("r_merge"), F.sum("all_refl").alias("all_refl"))


def _bins(method: str):
    def run(spark, sf_dir):
        li = table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 1e6).alias("x"))
        limits = reflections.bin_limits(li, "x", 10, method)
        return reflections.with_bin(li, limits, "x").groupBy("bin").agg(F.count("*").alias("n"))

    return run


_X = "with x as (select l_extendedprice / 1e6 as x from lineitem), "
query(_X + "r as (select x, row_number() over (order by x) - 1 as rn, count(*) over () as n from x), e as (select i, (select min(x) from r where rn = cast(floor(n / 20.0 * 2 * i) as bigint)) as lim from range(1, 10) t(i)) "
      "select cast(b as int) as bin, count(*) as n from (select (select count(*) from e where lim < x.x) as b from x) group by 1", "bin_equalcount")(_bins("equalcount"))  # fmt: skip
for _m, _p in (("dstar2", 1.0), ("dstar", 0.5), ("dstar3", 1.5)):
    query(_X + f"m as (select pow(min(x), {_p}) lo, pow(max(x), {_p}) hi from x), e as (select pow(lo + (hi - lo) * (2 * i) / 20, 1 / {_p}) as lim from m, range(1, 10) t(i)) "
          "select cast(b as int) as bin, count(*) as n from (select (select count(*) from e where lim < x.x) as b from x) group by 1", f"bin_{_m}")(_bins(_m))  # fmt: skip


def _pairs(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("bin"), F.col("l_extendedprice").alias("obs"), (F.col("l_quantity") * 1500).alias("calc"))


@query("select l_linenumber as bin, round(avg(l_extendedprice), 4) as mean from lineitem group by 1")
def bin_mean(spark, sf_dir):
    return rounded(reflections.bin_mean(_pairs(spark, sf_dir), "bin", "obs"), "mean", places=4)


@query("select l_linenumber as bin, round(sum(abs(l_extendedprice - l_quantity * 1500)) / sum(l_extendedprice), 6) as rfactor from lineitem group by 1")
def bin_rfactor(spark, sf_dir):
    return rounded(reflections.bin_rfactor(_pairs(spark, sf_dir), "bin", "obs", "calc"), "rfactor")


@query("select l_linenumber as bin, round(sum(abs(l_extendedprice - l_quantity * 1500)) / sum((l_extendedprice + l_quantity * 1500) / 2), 6) as rfactor from lineitem group by 1")
def bin_riso(spark, sf_dir):
    return rounded(reflections.bin_rfactor(_pairs(spark, sf_dir), "bin", "obs", "calc", riso=True), "rfactor")


@query("select l_linenumber as bin, round(corr(l_extendedprice, l_quantity * 1500), 6) as cc, count(*) as n from lineitem group by 1")
def bin_correlation(spark, sf_dir):
    return rounded(reflections.bin_correlation(_pairs(spark, sf_dir), "bin", "obs", "calc"), "cc")


_NORM = """with p as (select l_linenumber as bin, sum(pow(l_extendedprice / 1000, 2) / (1 + l_linenumber % 2)) / count(*) as m from lineitem group by 1),
q as (select bin, m, lag(m) over (order by bin) as a, lead(m) over (order by bin) as b from p),
n as (select bin, sqrt((coalesce(.75 * a, 0) + m + coalesce(.75 * b, 0)) / (1 + case when a is null then 0 else .75 end + case when b is null then 0 else .75 end)) as normalizer from q)"""


def _amplitudes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("bin"), (F.col("l_extendedprice") / 1000).alias("f"), (1 + F.col("l_linenumber") % 2).alias("eps"), "l_orderkey")


@query(_NORM + " select bin, round(normalizer, 6) as normalizer from n")
def normalizers(spark, sf_dir):
    return rounded(reflections.normalizers(_amplitudes(spark, sf_dir), "bin", "f", "eps"), "normalizer")


@query(_NORM + " select l_orderkey, n.bin as bin, round(l_extendedprice / 1000 / sqrt(1 + l_linenumber % 2) / normalizer, 6) as e from lineitem join n on l_linenumber = n.bin")
def e_values(spark, sf_dir):
    return rounded(reflections.e_values(_amplitudes(spark, sf_dir), "bin", "f", "eps").select("l_orderkey", "bin", "e"), "e")


@query("""select l_returnflag, round(var_samp(l_quantity), 6) as var, round(covar_samp(l_quantity, l_tax), 6) as cov, round(corr(l_quantity, l_extendedprice), 6) as cc, round(regr_slope(l_extendedprice, l_quantity), 4) as slope,
round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept, round(avg(l_extendedprice) / avg(l_quantity), 4) as mean_ratio from lineitem group by 1""")
def statistics(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_returnflag")
    y, x = "l_extendedprice", "l_quantity"
    return g.agg(F.round(F.var_samp(x), 6).alias("var"), F.round(F.covar_samp(x, "l_tax"), 6).alias("cov"), F.round(reflections.correlation(x, y), 6).alias("cc"), F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 3).alias("intercept"), F.round(F.avg(y) / F.avg(x), 4).alias("mean_ratio"))


@query("""with c as (select 'l_quantity' as "column", count(l_quantity) as n, 100.0 * count(l_quantity) / count(*) as filled, min(l_quantity) as "min", max(l_quantity) as "max", round(avg(l_quantity), 6) as mean, round(stddev_pop(l_quantity), 6) as rms from lineitem
union all select 'l_tax', count(l_tax), 100.0 * count(l_tax) / count(*), min(l_tax), max(l_tax), round(avg(l_tax), 6), round(stddev_pop(l_tax), 6) from lineitem) select "column", n, cast(filled as double) as filled, "min", "max", mean, rms from c""")
def column_statistics(spark, sf_dir):
    return rounded(reflections.column_statistics(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax"]), "mean", "rms")


def _two(spark, sf_dir):
    """Documents by their id and sums of events by user: whole tables whose keys overlap in part."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("n_chars").cast("double").alias("v"))
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(F.round(F.sum("value"), 2).alias("v"))
    return d, e


_A = "(select doc_id as key, cast(n_chars as double) as v from documents)"
_B = "(select user_id as key, round(sum(value), 2) as v from events group by 1)"


@query(f"select round(corr(a.v, b.v), 6) as cc, count(*) as n from {_A} a join {_B} b using (key)")
def matched_correlation(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return reflections.matched(a, b, ["key"]).agg(F.round(F.corr("v", "v_2"), 6).alias("cc"), F.count("*").alias("n"))


@query(f"select a.key as key, a.v as v, b.v as other from {_A} a left join {_B} b using (key)")
def copied_column(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return reflections.copied_column(a, b, ["key"], "v", "other")


@query(f"select case when b.key is null then 'only_1' when a.key is null then 'only_2' when abs(a.v - b.v) <= 1000 then 'same' else 'differs' end as status, count(*) as n from {_A} a full join {_B} b on a.key = b.key group by 1")
def compared(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return reflections.compared(a, b, ["key"], "v", 1000.0).groupBy("status").agg(F.count("*").alias("n"))


_P = "P 21 21 21"
_ASU = f"""select h, k, l, abs(h) as ah, abs(k) as ak, abs(l) as al, case when h >= 0 and k >= 0 and l >= 0 then 1 when -h >= 0 and -k >= 0 and -l >= 0 then 2 when -h >= 0 and k >= 0 and -l >= 0 then 3 when h >= 0 and -k >= 0 and l >= 0 then 4
 when -h >= 0 and -k >= 0 and l >= 0 then 5 when h >= 0 and k >= 0 and -l >= 0 then 6 when h >= 0 and -k >= 0 and -l >= 0 then 7 else 8 end as isym from {HKL}"""


@query(f"select ah, ak, al, isym, count(*) as n from ({_ASU}) group by 1, 2, 3, 4")
def asu_map(spark, sf_dir):
    a = spacegroup(_P).to_asu(F.col("h"), F.col("k"), F.col("l"))
    m = hkls(spark, sf_dir).select(a.alias("a"))
    return m.groupBy(F.col("a.h").alias("ah"), F.col("a.k").alias("ak"), F.col("a.l").alias("al"), F.col("a.isym").alias("isym")).agg(F.count("*").alias("n"))


@query(f"""select h, k, l, 1 + case when k = 0 and l = 0 then 1 else 0 end + case when h = 0 and l = 0 then 1 else 0 end + case when h = 0 and k = 0 then 1 else 0 end as epsilon, (h = 0 or k = 0 or l = 0) as centric,
((k = 0 and l = 0 and h % 2 <> 0) or (h = 0 and l = 0 and k % 2 <> 0) or (h = 0 and k = 0 and l % 2 <> 0)) as absent, round(1 / sqrt(h * h / pow(38.0, 2) + k * k / pow(44.0, 2) + l * l / pow(52.0, 2)), 6) as d from (select distinct h, k, l from {HKL}) where h <> 0 or k <> 0 or l <> 0""")
def reflection_properties(spark, sf_dir):
    g, (h, k, l) = spacegroup(_P), map(F.col, "hkl")
    u = hkls(spark, sf_dir).select("h", "k", "l").distinct().where("h <> 0 or k <> 0 or l <> 0")
    # At the origin all operations fix the reflection; elsewhere an axis does.
    return u.select("h", "k", "l", g.epsilon(h, k, l).alias("epsilon"), g.is_centric(h, k, l).alias("centric"), g.is_absent(h, k, l).alias("absent"), F.round(CELL.d(h, k, l), 6).alias("d"))


@query(f"""with g as (select ah, ak, al, case when ah = 0 or ak = 0 or al = 0 then 1 when isym % 2 = 1 then 1 else -1 end as isign, value, sigma from (select s.*, t.value, t.sigma from (select row_number() over () as i, * from ({_ASU})) s join (select row_number() over () as i, value, sigma from {HKL}) t using (i)))
select ah as h, ak as k, al as l, isign, count(*) as nobs from g group by 1, 2, 3, 4""")
def prepared_for_merging(spark, sf_dir):
    p = reflections.prepared(hkls(spark, sf_dir), spacegroup(_P))
    return p.groupBy("h", "k", "l", "isign").agg(F.count("*").alias("nobs"))


@query("""select h, k, l from (select cast(h as int) h, cast(k as int) k, cast(l as int) l from range(0, 10) a(h), range(0, 12) b(k), range(0, 14) c(l)) where h * h / pow(38.0, 2) + k * k / pow(44.0, 2) + l * l / pow(52.0, 2) between 1e-12 and 1 / 16.0
and not ((k = 0 and l = 0 and h % 2 <> 0) or (h = 0 and l = 0 and k % 2 <> 0) or (h = 0 and k = 0 and l % 2 <> 0))""")
def unique_reflections(spark, sf_dir):
    return reflections.all_reflections(spark, CELL, spacegroup(_P), 4.0)


@query(f"""with u as (select h, k, l from (select cast(h as int) h, cast(k as int) k, cast(l as int) l from range(0, 10) a(h), range(0, 12) b(k), range(0, 14) c(l)) where h * h / pow(38.0, 2) + k * k / pow(44.0, 2) + l * l / pow(52.0, 2) between 1e-12 and 1 / 16.0
and not ((k = 0 and l = 0 and h % 2 <> 0) or (h = 0 and l = 0 and k % 2 <> 0) or (h = 0 and k = 0 and l % 2 <> 0))), m as (select distinct abs(h) h, abs(k) k, abs(l) l from {HKL})
select count(*) as possible, count(m.h) as measured, round(count(m.h) / count(*), 6) as completeness from u left join m using (h, k, l)""")
def completeness(spark, sf_dir):
    m = hkls(spark, sf_dir).select(F.abs("h").alias("h"), F.abs("k").alias("k"), F.abs("l").alias("l"))
    return rounded(reflections.completeness(m, reflections.all_reflections(spark, CELL, spacegroup(_P), 4.0)), "completeness")


@query(f"""with u as (select distinct abs(h) as h, abs(k) as k, abs(l) as l from {HKL}) select cast(sum(case when (h = 0)::int + (k = 0)::int + (l = 0)::int = 0 then 4 when (h = 0)::int + (k = 0)::int + (l = 0)::int = 1 then 2 else 1 end) as bigint) as n from u""")
def expanded_to_p1(spark, sf_dir):
    u = hkls(spark, sf_dir).select(F.abs("h").alias("h"), F.abs("k").alias("k"), F.abs("l").alias("l")).distinct()
    return reflections.expanded_to_p1(u, spacegroup(_P)).agg(F.count("*").alias("n"))


@query(f"select count(*) as unique_refl, case when max(n - signs) > 0 then 'Unmerged' when max(signs) > 1 then 'Anomalous' else 'Mean' end as data_type from (select ah, ak, al, count(*) as n, count(distinct isym % 2) as signs from ({_ASU}) group by 1, 2, 3)")
def data_type(spark, sf_dir):
    return reflections.data_type(hkls(spark, sf_dir), spacegroup(_P))


@query(f"select h, k, l, value, sigma from {HKL} where value > 3 * sigma")
def sigma_cutoff(spark, sf_dir):
    return reflections.by_sigma_ratio(hkls(spark, sf_dir), 3.0)


@query("select round(exp(regr_intercept(ln(l_extendedprice / (l_quantity * 1500)), l_discount)), 6) as k, round(-regr_slope(ln(l_extendedprice / (l_quantity * 1500)), l_discount), 6) as b, count(*) as n from lineitem where l_extendedprice > 1")
def scale_fit(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("fo"), (F.col("l_quantity") * 1500).alias("fc"), "l_discount")
    return rounded(reflections.scale_factors(li, "fo", "fc", F.col("l_discount")), "k", "b")


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def check_parents(spark, sf_dir):
    d, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("of"))
    return cif_query.check_parents(d, ["doc_id"], labels, ["of"]).select("doc_id")


@query("select o_custkey, o_orderstatus, count(*) as n from orders group by 1, 2 having count(*) > 1")
def check_unique(spark, sf_dir):
    return cif_query.check_unique(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"])


def _items(spark, sf_dir) -> DataFrame:
    """Keys of events' JSON as tags of a block an event."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("path"), F.col("event_id").alias("block_idx"), F.col("user_id").cast("string").alias("block"), F.explode(F.from_json("props", "map<string,string>")).alias("k", "value_raw"))
    return e.select("path", "block_idx", "block", F.lit(None).cast("string").alias("frame"), F.lit(0).alias("item_idx"), F.lit("pair").alias("kind"), F.lit("props").alias("category"), F.concat(F.lit("_props."), "k").alias("tag"), F.lit(0).alias("row_idx"), F.lit(0).alias("col_idx"), "value_raw", F.lit(1).alias("line_no"))


_ITEMS = "(select event_type as path, event_id as block_idx, '_props.' || k as tag, json_extract_string(props, '$.\"' || k || '\"') as value_raw from (select *, unnest(json_keys(props)) as k from events))"


@query(f"select tag, count(*) as blocks, count(distinct path) as files, count(*) as total from {_ITEMS} where value_raw not in ('?', '.') group by 1")
def tag_statistics(spark, sf_dir):
    return cif_query.tag_statistics(_items(spark, sf_dir)).select("tag", "blocks", "files", "total")


@query(f"select tag, value_raw, n from (select *, row_number() over (partition by tag order by n desc, value_raw) as r from (select tag, value_raw, count(*) as n from {_ITEMS} group by 1, 2)) where r <= 10")
def top_values(spark, sf_dir):
    return cif_query.top_values(_items(spark, sf_dir), "tag", "value_raw").select("tag", "value_raw", "n")


@query("select lang, count(*) as n from documents where regexp_matches(text, '[0-9]{3}') group by 1")
def grep_documents(spark, sf_dir):
    """Documents as items of files by language, their texts as tags: the tag search by a regular expression."""
    d = table(spark, sf_dir, "documents")
    items = d.select(F.col("lang").alias("path"), F.col("doc_id").alias("block_idx"), F.lit("d").alias("block"), F.lit(None).cast("string").alias("frame"), F.lit(0).alias("item_idx"), F.lit("pair").alias("kind"), F.lit("").alias("category"), F.col("text").alias("tag"), F.lit(0).alias("row_idx"), F.lit(0).alias("col_idx"), F.lit("x").alias("value_raw"), F.lit(1).alias("line_no"))
    return cif_query.grep(items, "[0-9]{3}", "regex", raw=True).groupBy(F.col("path").alias("lang")).agg(F.count("*").alias("n"))


@query(f"select path, cast(block_idx as bigint) as block_idx, tag, value_raw from {_ITEMS} where regexp_matches(tag, '^_props\\.k.*$')")
def grep_glob(spark, sf_dir):
    return cif_query.grep(_items(spark, sf_dir), "_props.k*", "glob", raw=True).select("path", "block_idx", "tag", "value_raw")


@query("""select o_orderkey, round(o_totalprice, 2) as number, cast(o_custkey as int) as whole, (o_orderstatus = 'F') as missing, o_orderpriority as word from orders""")
def cif_values(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    raw = o.select("o_orderkey", F.concat(F.format_string("%.2f", F.col("o_totalprice")), F.lit("(5)")).alias("n"), F.col("o_custkey").cast("string").alias("i"), F.when(F.col("o_orderstatus") == "F", "?").otherwise("'?'").alias("q"), F.concat(F.lit("'"), "o_orderpriority", F.lit("'")).alias("s"))
    return raw.select("o_orderkey", values.cif_number(F.col("n")).alias("number"), values.cif_int(F.col("i")).alias("whole"), values.is_null(F.col("q")).alias("missing"), values.cif_string(F.col("s")).alias("word"))


@query(f"select serial, chain, atom from {ATM} where chain in ('1', '3') and seqnum between 10 and 200 and resname not in ('STA') and atom = 'CA' and occ < 0.5 and b_iso > 46")
def selection_cid(spark, sf_dir):
    return atoms(spark, sf_dir).where(selection.cid("/1/1,3/10-200(!STA)/CA;q<0.5;b>46")).select("serial", "chain", "atom")


@query(f"select serial, chain, atom from {ATM} where chain = '2' and not (resname = 'PRO' or b_iso > 60) and atom in ('CA', 'C', 'N', 'O') and seqnum between 5 and 300")
def selection_pymol(spark, sf_dir):
    return atoms(spark, sf_dir).where(selection.pymol("chain 2 and not (resn PRO or b > 60) and backbone and resi 5-300")).select("serial", "chain", "atom")


@query(f"select serial, chain, seqnum, atom from (select *, row_number() over (partition by model, chain, res_ord, atom order by atom_ord) as r from {ATM}) where r = 1")
def first_conformer(spark, sf_dir):
    return model.first_conformer(atoms(spark, sf_dir)).select("serial", "chain", "seqnum", "atom")


@query(f"select chain, round(sum(m * occ), 4) as mass, round(sum(m * occ * x) / sum(m * occ), 6) as centre_x, round(sum(m * occ * y) / sum(m * occ), 6) as centre_y, round(sum(m * occ * z) / sum(m * occ), 6) as centre_z from (select *, case element when 'C' then 12.0107 when 'N' then 14.0067 else 15.9994 end as m from {ATM}) group by 1")
def mass(spark, sf_dir):
    return rounded(rounded(model.mass_and_centre(atoms(spark, sf_dir), ["chain"]), "mass", places=4), "centre_x", "centre_y", "centre_z")


@query(f"select chain, min(x) - 2 as min_x, min(y) - 2 as min_y, min(z) - 2 as min_z, max(x) + 2 as max_x, max(y) + 2 as max_y, max(z) + 2 as max_z from {ATM} group by 1")
def bounding_box(spark, sf_dir):
    return model.bounding_box(atoms(spark, sf_dir), ["chain"], 2.0)


@query(f"select chain, count(*) as sites, round(sum(occ), 6) as occupancy, count(distinct res_ord) as residues, min(b_iso) as b_min, max(b_iso) as b_max from {ATM} group by 1")
def contents(spark, sf_dir):
    return rounded(model.counts(atoms(spark, sf_dir), ["chain"]), "occupancy")


@query(f"select resname, count(*) as n, round(sqrt(avg(pow((b_iso - 50) / 12, 2))), 6) as rmsz, count(*) filter (abs((b_iso - 50) / 12) > 2) as outliers from {ATM} group by 1")
def rmsz(spark, sf_dir):
    v = atoms(spark, sf_dir).select("resname", F.col("b_iso").alias("value"), F.lit(50.0).alias("ideal"), F.lit(12.0).alias("esd"))
    return rounded(model.rmsz(v, ["resname"]), "rmsz")


@query(f"select chain, seqnum, step from (select distinct chain, seqnum, seqnum - lag(seqnum) over (partition by chain order by seqnum) as step from (select distinct chain, seqnum from {ATM})) where step <> 1")
def numbering_gaps(spark, sf_dir):
    r = atoms(spark, sf_dir).select("model", "chain", "seqnum", "res_ord").distinct()
    return model.numbering_gaps(r).select("chain", "seqnum", "step")


@query(f"select a.serial as serial, b.serial as serial_2, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)), 6) as dist from {PTS} a join {PTS} b on a.serial < b.serial and pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) < 1")
def neighbours(spark, sf_dir):
    p = points(spark, sf_dir)
    return rounded(spatial.neighbours(p, p, 1.0).where("serial < serial_2").select("serial", "serial_2", "dist"), "dist")


@query(f"select a.serial as serial, round(sum(1 / (pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))), 3) as wcn from {PTS} a join {PTS} b on a.serial <> b.serial and pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) between 1e-9 and 3.999999 group by 1")
def contact_number(spark, sf_dir):
    p = points(spark, sf_dir)
    pairs = spatial.neighbours(p, p, 2.0, min_dist=10**-4.5).where("serial <> serial_2 and dist * dist <= 3.999999")
    return rounded(spatial.contact_number(pairs, "serial"), "wcn", places=3)


@query(f"select serial, round(min(d), 6) as dist from (select a.serial, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) as d from {PTS} a join {PTS} b on a.serial <> b.serial and a.label = b.label) where d < 3 group by 1")
def nearest_atom(spark, sf_dir):
    p = points(spark, sf_dir)
    pairs = spatial.neighbours(p, p, 3.0, on=("label",)).where("serial <> serial_2")
    return rounded(spatial.nearest(pairs, ["serial"]).select("serial", "dist"), "dist")


@query(f"""with f as (select serial, x / 38 as x, y / 44 as y, z / 52 as z from {PTS}), i as (select serial, x, y, z, unnest([{{'a': x, 'b': y, 'c': z}}, {{'a': -x, 'b': y + .5, 'c': .5 - z}}, {{'a': .5 - x, 'b': -y, 'c': z + .5}}, {{'a': x + .5, 'b': .5 - y, 'c': -z}}]) as m from f),
d as (select serial, .1 - m.a as a, .2 - m.b as b, .3 - m.c as c from i) select serial, round(sqrt(min(pow(38 * (a - round_even(a, 0)), 2) + pow(44 * (b - round_even(b, 0)), 2) + pow(52 * (c - round_even(c, 0)), 2))), 5) as dist from d group by 1""")
def nearest_image(spark, sf_dir):
    p = points(spark, sf_dir).select("serial", *(v.alias(f"f{c}") for v, c in zip(CELL.fractional(F.col("x"), F.col("y"), F.col("z")), "xyz", strict=True)), F.lit(0.1).alias("a"), F.lit(0.2).alias("b"), F.lit(0.3).alias("c"))
    near = spatial.nearest_image(p, CELL, spacegroup(_P), ("a", "b", "c"), ("fx", "fy", "fz"))
    return rounded(near.select("serial", "dist"), "dist", places=5)


@query(f"""with p as (select serial, x, y, z, lag(x) over w as ax, lag(y) over w as ay, lag(z) over w as az, lead(x) over w as cx, lead(y) over w as cy, lead(z) over w as cz, lead(x, 2) over w as dx, lead(y, 2) over w as dy, lead(z, 2) over w as dz from {PTS} window w as (partition by label order by serial)),
v as (select serial, x - ax as ux, y - ay as uy, z - az as uz, cx - x as vx, cy - y as vy, cz - z as vz, dx - cx as wx, dy - cy as wy, dz - cz as wz from p where ax is not null and dx is not null),
n as (select *, uy * vz - uz * vy as mx, uz * vx - ux * vz as my, ux * vy - uy * vx as mz, vy * wz - vz * wy as nx, vz * wx - vx * wz as ny, vx * wy - vy * wx as nz from v)
select serial, round(degrees(atan2((ux * nx + uy * ny + uz * nz) * sqrt(vx * vx + vy * vy + vz * vz), mx * nx + my * ny + mz * nz)), 4) as torsion from n""")
def torsion_window(spark, sf_dir):
    from pyspark.sql import Window as W

    w = W.partitionBy("label").orderBy("serial")
    p = points(spark, sf_dir)
    at = lambda n: tuple((F.lag(c, -n) if n < 0 else F.lag(c, n)).over(w) if n > 0 else F.lead(c, -n).over(w) if n < 0 else F.col(c) for c in "xyz")
    t = p.withColumn("torsion", F.round(F.degrees(dihedral(at(1), at(0), at(-1), at(-2))), 4))
    return t.where("torsion is not null").select("serial", "torsion")


@query(f"select ah as h, ak as k, al as l, isym, row_number() over (order by ah, ak, al, isym) - 1 as place from (select distinct ah, ak, al, isym from ({_ASU}))")
def sorted_reflections(spark, sf_dir):
    """Reflections of the asymmetric unit in their order, by exact ranks over ranges."""
    a = spacegroup(_P).to_asu(F.col("h"), F.col("k"), F.col("l"))
    r = hkls(spark, sf_dir).select(a.alias("a")).select("a.h", "a.k", "a.l", "a.isym").distinct().withColumn("key", F.struct("h", "k", "l", "isym"))
    return reflections.exact_ranks(r, "key").select("h", "k", "l", "isym", F.col("_rank").alias("place"))


@query("""select hkl.h as h, hkl.k as k, hkl.l as l, round(sum(exp(-0.5 * (h * h / pow(38.0, 2) + k * k / pow(44.0, 2) + l * l / pow(52.0, 2))) * 6 * cos(2 * pi() * (h * fx + k * fy + l * fz))), 4) as re,
round(sum(exp(-0.5 * (h * h / pow(38.0, 2) + k * k / pow(44.0, 2) + l * l / pow(52.0, 2))) * 6 * sin(2 * pi() * (h * fx + k * fy + l * fz))), 4) as im
from (select cast(a as int) h, cast(b as int) k, cast(c as int) l from range(-2, 3) x(a), range(-2, 3) y(b), range(-2, 3) z(c)) hkl, (select x / 38 as fx, y / 44 as fy, z / 52 as fz from """ + PTS + """) group by 1, 2, 3""")  # fmt: skip
def structure_factors(spark, sf_dir):
    p = points(spark, sf_dir)
    f = CELL.fractional(F.col("x"), F.col("y"), F.col("z"))
    a = p.select(*(v.alias(f"f{c}") for v, c in zip(f, "xyz", strict=True)), "occ", F.lit(2.0).alias("b_iso"), F.array(F.lit(6.0)).alias("a"), F.array(F.lit(0.0)).alias("b"), F.lit(0.0).alias("c"))
    axis = lambda n: spark.range(-2, 3).select(F.col("id").cast("int").alias(n))
    hkl = axis("h").crossJoin(axis("k")).crossJoin(axis("l"))
    return rounded(grid.structure_factors(hkl, a, CELL, spacegroup("P 1")), "re", "im", places=4)


def _grid(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    i = lambda c: (F.col(c) % 16).cast("int")
    return li.groupBy(i("l_orderkey").alias("u"), i("l_partkey").alias("v"), i("l_suppkey").alias("w")).agg(F.sum("l_quantity").alias("value"))


_GRID = "(select cast(l_orderkey % 16 as int) u, cast(l_partkey % 16 as int) v, cast(l_suppkey % 16 as int) w, sum(l_quantity) as value from lineitem group by 1, 2, 3)"


@query(f"""with i as (select *, unnest([{{'a': u, 'b': v, 'c': w}}, {{'a': (32 - u) % 16, 'b': (v + 8) % 16, 'c': (24 - w) % 16}}, {{'a': (24 - u) % 16, 'b': (32 - v) % 16, 'c': (w + 8) % 16}}, {{'a': (u + 8) % 16, 'b': (24 - v) % 16, 'c': (32 - w) % 16}}]) as m from {_GRID}),
o as (select u, v, w, value, min(m.a * 256 + m.b * 16 + m.c) as orbit from i group by 1, 2, 3, 4) select o.u as u, o.v as v, o.w as w, q.value as value from o join (select orbit, max(value) as value from o group by 1) q on o.orbit = q.orbit""")
def grid_symmetrized(spark, sf_dir):
    return grid.symmetrized(_grid(spark, sf_dir), spacegroup(_P), (16, 16, 16), "max")


@query(f"select u, v, w, round((value - (select avg(value) from {_GRID})) / (select stddev_pop(value) from {_GRID}), 6) as value from {_GRID}")
def grid_normalized(spark, sf_dir):
    return rounded(grid.normalized(_grid(spark, sf_dir)), "value")


@query(f"""with p as (select serial, x / 38 as fx, y / 44 as fy, z / 52 as fz from {PTS}), q as (select serial, floor(fx * 16)::int as u, floor(fy * 16)::int as v, floor(fz * 16)::int as w, fx * 16 - floor(fx * 16) as du, fy * 16 - floor(fy * 16) as dv, fz * 16 - floor(fz * 16) as dw from p),
k as (select q.*, i, j, m from q, range(2) a(i), range(2) b(j), range(2) c(m)), s as (select serial, (((u + i) % 16 + 16) % 16)::int as u, (((v + j) % 16 + 16) % 16)::int as v, (((w + m) % 16 + 16) % 16)::int as w, case i when 1 then du else 1 - du end * case j when 1 then dv else 1 - dv end * case m when 1 then dw else 1 - dw end as t from k)
select serial, round(sum(t * g.value), 4) as value from s join {_GRID} g using (u, v, w) group by 1""")
def grid_interpolated(spark, sf_dir):
    f = CELL.fractional(F.col("x"), F.col("y"), F.col("z"))
    p = points(spark, sf_dir).select("serial", *(v.alias(f"f{c}") for v, c in zip(f, "xyz", strict=True)))
    return rounded(grid.interpolated(p, _grid(spark, sf_dir), (16, 16, 16)).select("serial", "value"), "value", places=4)


@query()
def grid_blobs(spark, sf_dir):
    ship_package(spark)
    g = _grid(spark, sf_dir)
    top = g.approxQuantile("value", [0.9], 0.001)[0]
    return rounded(grid.blobs(g, top, CELL, (16, 16, 16)), "score", "volume").drop("peak_at")


@query()
def fourier_map(spark, sf_dir):
    ship_package(spark)
    g = grid.reciprocal_points(hkls(spark, sf_dir).groupBy("h", "k", "l").agg(F.avg("value").alias("f"), F.avg("sigma").alias("phi")), spacegroup("P 1"), "f", "phi").withColumn("m", F.lit(1))
    return rounded(grid.map_from_coefficients(g, ["m"], (24, 24, 16), CELL.volume), "value")


@query()
def aligned_names(spark, sf_dir):
    ship_package(spark)
    n = table(spark, sf_dir, "nation").select("n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return alignment.align_pairs(n.join(r, "n_regionkey"), "n_name", "r_name")


@query()
def superposed_labels(spark, sf_dir):
    ship_package(spark)
    p = points(spark, sf_dir).where("label is not null")
    pairs = p.select("label", "x", "y", "z", F.col("y").alias("x_2"), F.col("z").alias("y_2"), F.col("x").alias("z_2"))
    return rounded(alignment.superposed(pairs, ["label"]), "rmsd").select("label", "n", "rmsd")


@query()
def best_planes(spark, sf_dir):
    ship_package(spark)
    return rounded(alignment.best_planes(points(spark, sf_dir), ["label"]), "least").select("label", "n", "least")


@query("select n_nationkey as comp, n_regionkey as hub, count(*) over (partition by n_regionkey) - 1 as reach from nation")
def bond_reach(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    bonds = n.select(F.lit("X").alias("comp_id"), F.concat(F.lit("n"), "n_nationkey").alias("a"), F.concat(F.lit("r"), "n_regionkey").alias("b"))
    start = bonds.select("comp_id", "a").distinct()
    far = chemistry.bond_distance(bonds, start, 2).where("n = 2").groupBy("a").agg(F.count("*").alias("reach"))
    named = n.select(F.col("n_nationkey").alias("comp"), F.col("n_regionkey").alias("hub"), F.concat(F.lit("n"), "n_nationkey").alias("a"))
    return named.join(far, "a", "left").select("comp", "hub", F.coalesce("reach", F.lit(0)).cast("long").alias("reach"))


@query("select date_trunc('hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total, min(value) as low, max(value) as high from events group by 1, 2")
def tumbling_statistics(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    out = merging.run_once(merging.tumbling(stream, "ts", "value", "1 hour", "1 hour", ["event_type"]), "tumbling_statistics")
    return rounded(out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")), "total", places=4)


@query(_stats_sql("Y", "shell // 4"))
def merge_stats_combined(spark, sf_dir):
    """Sums of shells added up four at a time, then the statistics."""
    sums = reflections.merging_sums(observations(spark, sf_dir), KEYS, "shell")
    four = sums.groupBy(F.floor(F.col("shell") / 4).cast("int").alias("shell")).agg(*(F.sum(c).alias(c) for c in sums.columns if c != "shell"))
    return rounded(reflections.merging_statistics(four).drop("cc_star"), "r_merge", "r_meas", "r_pim", "cc_half")


@query(f"select label, count(*) as n, round(corr(x, y), 6) as cc, round(corr(rx, ry), 6) as rank_cc from (select label, x, y, rank() over (partition by label order by x) + (count(*) over (partition by label, x) - 1) / 2.0 as rx, rank() over (partition by label order by y) + (count(*) over (partition by label, y) - 1) / 2.0 as ry from {PTS}) group by 1")
def rank_correlation(spark, sf_dir):
    r = structure.ranks(structure.ranks(points(spark, sf_dir), ["label"], "x", "rx"), ["label"], "y", "ry")
    return r.groupBy("label").agg(F.count("*").alias("n"), F.round(F.corr("x", "y"), 6).alias("cc"), F.round(F.corr("rx", "ry"), 6).alias("rank_cc"))


@query(f"""select count(*) as n_rows, count(distinct (h, k, l)) as unique_hkl, count(distinct case when h < 0 or (h = 0 and (k < 0 or (k = 0 and l < 0))) then (-h, -k, -l) else (h, k, l) end) as unique_mates, h % 2 = 0 as even,
case when count(*) > count(distinct (h, k, l)) then 'Y' when count(distinct (h, k, l)) > count(distinct case when h < 0 or (h = 0 and (k < 0 or (k = 0 and l < 0))) then (-h, -k, -l) else (h, k, l) end) then 'F' else 'N' end as duplicates from {HKL} group by h % 2 = 0""")
def reflection_statistics(spark, sf_dir):
    return composite.reflection_statistics(hkls(spark, sf_dir).withColumn("even", F.col("h") % 2 == 0), ["even"])


@query(f"select floor((h * h / pow(38.0, 2) + k * k / pow(44.0, 2) + l * l / pow(52.0, 2)) * 100)::int as shell, count(*) as n, round(avg(value / sigma), 6) as i_sigma from {HKL} where h <> 0 or k <> 0 or l <> 0 group by 1")
def signal_to_noise(spark, sf_dir):
    r = composite.signal(hkls(spark, sf_dir).where("h <> 0 or k <> 0 or l <> 0"), CELL)
    return r.groupBy(F.floor(F.col("inv_d2") * 100).cast("int").alias("shell")).agg(F.count("*").alias("n"), F.round(F.avg("i_sigma"), 6).alias("i_sigma"))


@query("select p_partkey, round(p_retailprice * 100 / 4 / (p_size * 1000), 6) as vm, round(100 * (1 - 1 / (1.35 * (p_retailprice * 100 / 4 / (p_size * 1000)) * 0.602214)), 4) as solvent_135 from part")
def matthews_survey(spark, sf_dir):
    e = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") * 100).alias("volume"), (F.col("p_size") * 1000).alias("weight"), F.lit(4).alias("n_images"))
    m = composite.matthews_survey(e)
    return m.select("p_partkey", F.round("vm", 6).alias("vm"), F.round("solvent_135", 4).alias("solvent_135"))


@query(f"select ah as h, ak as k, al as l, max(value) filter (isym % 2 = 1) as f_plus, max(value) filter (isym % 2 = 0) as f_minus from (select s.*, t.value from (select row_number() over () as i, * from ({_ASU})) s join (select row_number() over () as i, value from {HKL}) t using (i)) group by 1, 2, 3")
def anomalous_columns(spark, sf_dir):
    rows = hkls(spark, sf_dir).select("h", "k", "l", F.col("value").alias("f"), F.col("sigma").alias("sigf"))
    return crystallography.anomalous_columns(rows, spacegroup(_P)).select("h", "k", "l", "f_plus", "f_minus")


@query(f"""with r as (select 'H' as ss, c as chain, f as first, f + 12 as last from (values ('1'), ('2'), ('3')) x(c), (values (10), (60), (200)) y(f)) select a.serial as serial, r.ss as ss from {ATM} a left join r on a.chain = r.chain and a.seqnum between r.first and r.last""")
def secondary_structure(spark, sf_dir):
    ranges = spark.createDataFrame([(c, f, f + 12, "H") for c in "123" for f in (10, 60, 200)], "chain string, first int, last int, ss string")
    return model.secondary_structure(atoms(spark, sf_dir), ranges).select("serial", "ss")


@query(f"select serial from (select *, max(case when atom = 'CA' and element = 'C' then 1 else 0 end) over (partition by model, chain, res_ord) as ca from {ATM}) where ca = 0 or atom in ('N', 'CA', 'C', 'O', 'CB', 'OXT')")
def trimmed_to_alanine(spark, sf_dir):
    return model.trimmed_to_alanine(atoms(spark, sf_dir)).select("serial")


@query(f"select serial, row_number() over (partition by model order by atom_ord) + 4 as new_serial from {ATM}")
def renumbered(spark, sf_dir):
    a = atoms(spark, sf_dir)
    return model.serials(a, 5).select(F.col("atom_ord").cast("long").alias("serial"), F.col("serial").cast("long").alias("new_serial"))


@query(f"select serial, chain || 'x' || case when resname = 'PRO' then 'p' else cast(dense_rank() over (partition by model, chain, resname = 'PRO' order by res_ord) as varchar) end as subchain from {ATM}")
def subchains(spark, sf_dir):
    return structure.subchains(model.entity_types(atoms(spark, sf_dir))).select("serial", "subchain")


@query(f"select serial, least(greatest(b_iso, 40), 60) as b_iso from {ATM}")
def clamped_b(spark, sf_dir):
    return model.clamped(atoms(spark, sf_dir), "b_iso", 40.0, 60.0).select("serial", "b_iso")


@query("""with t as (select l_linenumber as key, x, x * x as fp, lead(x) over (partition by l_linenumber order by x) as x1 from (select distinct l_linenumber, l_quantity - l_quantity % 10 as x from lineitem))
select l_orderkey, l_linenumber, round(t.fp + (l_quantity - t.x) / (t.x1 - t.x) * (t.x1 * t.x1 - t.fp), 6) as fp from lineitem left join t on key = l_linenumber and l_quantity >= t.x and l_quantity < t.x1""")
def interpolated_table(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    t = li.select("l_linenumber", (F.col("l_quantity") - F.col("l_quantity") % 10).alias("l_quantity")).distinct().withColumn("fp", F.col("l_quantity") * F.col("l_quantity"))
    return rounded(numeric.interpolated_table(li, t, "l_linenumber", "l_quantity", ["fp"]).select("l_orderkey", "l_linenumber", "fp"), "fp")


@query("select l_orderkey, l_linenumber, round(ln(cosh((l_quantity - 25) / 10)), 6) as log_cosh, round(exp(-l_quantity * l_tax), 6) as dw from lineitem")
def special_functions(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.round(numeric.log_cosh((F.col("l_quantity") - 25) / 10), 6).alias("log_cosh"), F.round(numeric.debye_waller(F.col("l_quantity"), F.col("l_tax")), 6).alias("dw"))


@query(f"select (a.value > 20)::int as first, (b.value > 20)::int as second, count(*) as n from {_GRID} a join {_GRID} b on b.u = (a.u + 1) % 16 and a.v = b.v and a.w = b.w group by 1, 2")
def mask_confusion(spark, sf_dir):
    g = _grid(spark, sf_dir).withColumn("value", (F.col("value") > 20).cast("double"))
    return composite.mask_confusion(g, g.withColumn("u", (F.col("u") + 15) % 16))


@query(f"select u, v, w, (u + 12) % 16 as i, (v + 2) % 16 as j, (w + 16) % 16 as k, value from {_GRID} where (u + 12) % 16 < 6 and (v + 2) % 16 < 5 and w < 4")
def grid_subarray(spark, sf_dir):
    return grid.subarray(_grid(spark, sf_dir), (4, -2, 0), (6, 5, 4), (16, 16, 16))


@query()
def solvent_mask(spark, sf_dir):
    a = points(spark, sf_dir).withColumn("radius", F.lit(1.7))
    return grid.solvent_mask(a, CELL, (38, 44, 52))


@query()
def model_density(spark, sf_dir):
    a = points(spark, sf_dir).withColumns({"b_iso": F.lit(20.0), "z_number": F.lit(6.0)})
    return rounded(grid.model_density(a, CELL, (38, 44, 52), 2.5), "value")


@query()
def crystal_contacts(spark, sf_dir):
    a = points(spark, sf_dir).withColumns({"chain": F.lit("A"), "res_ord": F.col("serial").cast("int"), "atom_ord": F.col("serial").cast("int"), "altloc": F.lit("")})
    pairs = spatial.crystal_neighbours(a, CELL, spacegroup(_P), 1.5)
    return rounded(spatial.contacts(pairs.withColumn("image_2", F.col("image_2"))).select("serial", "serial_2", "image_2", "dist"), "dist")


# Line items as items of CIF loops: an order is a block, its lines are rows.


def _loops(spark, sf_dir, single: bool = False) -> DataFrame:
    """single: one row for each order and line number, which the supplied table repeats."""
    li = table(spark, sf_dir, "lineitem")
    if single:
        li = li.groupBy("l_orderkey", "l_linenumber").agg(*(F.max(c).alias(c) for c in ("l_quantity", "l_returnflag", "l_shipdate")))
    tags = ["id", "quantity", "flag", "ship"]
    value = F.array(*(F.struct(F.lit(i).alias("col_idx"), F.lit(f"_line.{t}").alias("tag"), v.alias("value_raw")) for i, (t, v) in enumerate(zip(tags, (F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string"), F.when(F.col("l_returnflag") == "N", "?").otherwise(F.col("l_returnflag")), F.date_format("l_shipdate", "yyyy-MM-dd")), strict=True))))
    return li.select(F.concat(F.lit("f"), (F.col("l_orderkey") % 10).cast("string")).alias("path"), F.col("l_orderkey").alias("block_idx"), F.col("l_orderkey").cast("string").alias("block"), F.lit(None).cast("string").alias("frame"), F.lit(0).alias("item_idx"), F.lit("loop").alias("kind"), F.lit("line").alias("category"), (F.col("l_linenumber") - 1).cast("int").alias("row_idx"), F.lit(1).alias("line_no"), F.inline(value))


@query("select cast(l_orderkey as bigint) as block_idx, cast(l_linenumber - 1 as int) as row_idx, cast(l_linenumber as varchar) as id, cast(cast(l_quantity as int) as varchar) as quantity from (select l_orderkey, l_linenumber, max(l_quantity) as l_quantity, max(l_returnflag) as l_returnflag from lineitem group by 1, 2)")
def find_table(spark, sf_dir):
    t = cif_query.find_table(_loops(spark, sf_dir, True), "_line.", ["id", "quantity", "?nothing"])
    return t.select("block_idx", "row_idx", F.col("`_line.id`").alias("id"), F.col("`_line.quantity`").alias("quantity"))


@query("select cast(l_orderkey as bigint) as block_idx, cast(l_linenumber - 1 as int) as row_idx, l_returnflag as flag, cast(cast(l_quantity as int) as varchar) as quantity from (select l_orderkey, l_linenumber, max(l_quantity) as l_quantity, max(l_returnflag) as l_returnflag from lineitem group by 1, 2) where l_returnflag <> 'N'")
def grep_and(spark, sf_dir):
    g = cif_query.grep_and(_loops(spark, sf_dir, True), "_line.flag", ["_line.quantity"])
    return g.select("block_idx", "row_idx", F.col("`_line.flag`").alias("flag"), F.col("`_line.quantity`").alias("quantity"))


@query("""with v as (select 'f' || (l_orderkey % 10) as path, l_orderkey as b, unnest([{'t': '_line.id', 'x': l_linenumber::double}, {'t': '_line.quantity', 'x': l_quantity}]) as u from lineitem), p as (select u.t as tag, path, b, count(*) as n, min(u.x) as x0, max(u.x) as x1 from v group by 1, 2, 3)
select tag, count(*) as blocks, count(distinct path) as files, cast(sum(n) as bigint) as total, min(n) as min_count, round(avg(n), 6) as avg_count, max(n) as max_count, min(x0) as min_value, max(x1) as max_value from p group by tag""")
def tag_statistics_of_loops(spark, sf_dir):
    s = cif_query.tag_statistics(_loops(spark, sf_dir)).where("tag in ('_line.id', '_line.quantity')")
    return rounded(s.select("tag", "blocks", "files", "total", "min_count", "avg_count", "max_count", "min_value", "max_value"), "avg_count")


@query("""select cast(l_orderkey as bigint) as block_idx, tag, problem from (select l_orderkey, '_line.quantity' as tag, 'range' as problem from lineitem where not (l_quantity > 1 and l_quantity < 49) group by 1
union all select l_orderkey, '_line.flag', 'enumeration' from lineitem where l_returnflag = 'A' group by 1 union all select l_orderkey, '_line.ship', 'unknown tag' from lineitem group by 1 union all select l_orderkey, '_line.id', 'type' from lineitem where l_linenumber > 5 group by 1)""")
def check_values(spark, sf_dir):
    rules = spark.createDataFrame([("_line.id", "[1-5]", None, None, None), ("_line.quantity", None, None, 1.0, 49.0), ("_line.flag", None, ["R"], None, None)], "tag string, type_regex string, enumeration array<string>, low double, high double")
    return cif_query.check_values(_loops(spark, sf_dir), rules).select("block_idx", "tag", "problem")


@query("select cast(block_idx as bigint) as block_idx, '_line.nothing' as tag from (select distinct l_orderkey as block_idx from lineitem)")
def check_mandatory(spark, sf_dir):
    rules = spark.createDataFrame([("_line.id", True), ("_line.nothing", True), ("_other.x", True)], "tag string, mandatory boolean")
    return cif_query.check_mandatory(_loops(spark, sf_dir), rules).select("block_idx", "tag")


@query("""with a as (select l_orderkey, l_linenumber, l_quantity::int as q from lineitem), b as (select l_orderkey, l_linenumber, (case when l_quantity > 40 then 40 else l_quantity end)::int as q from lineitem)
select cast(coalesce(a.l_orderkey, b.l_orderkey) as varchar) as block, cast(coalesce(a.l_linenumber, b.l_linenumber) - 1 as int) as row_idx, cast(a.q as varchar) as v1, cast(b.q as varchar) as v2 from a full join b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber where a.q is distinct from b.q""")
def differences(spark, sf_dir):
    q = _loops(spark, sf_dir).where("tag = '_line.quantity'")
    b = q.withColumn("value_raw", F.least(F.col("value_raw").cast("int"), F.lit(40)).cast("string"))
    return cif_query.differences(q, b).select("block", "row_idx", "v1", "v2")


@query("select 'f' || (l_orderkey % 10) as path, count(*) as n from lineitem where l_returnflag <> 'N' group by 1")
def grep_counts(spark, sf_dir):
    return cif_query.grep(_loops(spark, sf_dir), "_line.flag").groupBy("path").agg(F.count("*").alias("n"))


@query("select path, cast(b as bigint) as block_idx, cast(row_idx as int) as row_idx, value_raw from (select 'f' || (l_orderkey % 10) as path, l_orderkey as b, l_linenumber - 1 as row_idx, cast(l_linenumber as varchar) as value_raw, row_number() over (partition by l_orderkey % 10 order by l_orderkey, l_linenumber) as r from lineitem) where r <= 5")
def grep_max_count(spark, sf_dir):
    return cif_query.grep(_loops(spark, sf_dir), "_line.id", max_per_file=5).select("path", "block_idx", "row_idx", "value_raw")


@query("select count(*) as cubes from (select l_orderkey, count(*) as n from lineitem group by 1 having count(*) > 5)")
def blocks_with_many(spark, sf_dir):
    return composite.blocks_with_many(_loops(spark, sf_dir), "_line.id", 5).agg(F.count("*").alias("cubes"))


@query(f"select round(corr(a.value, b.value), 6) as cc, round(regr_slope(b.value, a.value), 6) as slope, count(*) as n from {_GRID} a join {_GRID} b on b.u = (a.u + 1) % 16 and a.v = b.v and a.w = b.w")
def grid_correlation(spark, sf_dir):
    g = _grid(spark, sf_dir)
    return rounded(grid.grid_correlation(g, g.withColumn("u", (F.col("u") + 15) % 16)), "cc", "slope")


@query(f"select a.serial as serial, b.serial as serial_2, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)), 6) as dist from {PTS} a join {PTS} b on a.serial < b.serial and pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) < 1.44 and sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) <= 0.76 * 2 * 0.7")
def possible_links(spark, sf_dir):
    p = points(spark, sf_dir).withColumns({"resname": F.lit("X"), "atom": F.lit("C"), "element": F.lit("C")})
    known = spark.createDataFrame([], "resname string, atom string, resname_2 string, atom_2 string, ideal double, link string")
    pairs = spatial.neighbours(p, p, 1.2).where("serial < serial_2")
    return rounded(structure.possible_links(pairs, known, radius_margin=0.7).select("serial", "serial_2", "dist"), "dist")


@query("select o_orderkey, res_ord, round(value, 2) as value, round((value - 1000) / 50000, 6) as z from (select o_orderkey, o_custkey as res_ord, o_totalprice as value from orders) where abs((value - 1000) / 50000) > 3")
def restraint_outliers(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("res_ord"), F.col("o_totalprice").alias("value"), F.lit(1000.0).alias("ideal"), F.lit(50000.0).alias("esd"))
    return rounded(rounded(topology.outliers(o, 3.0), "z"), "value", places=2).select("o_orderkey", "res_ord", "value", "z")


@query("""with b as (select *, 1 as one from lineitem) select round(c[1], 4) as k, round(c[2], 6) as b from (select [exp(regr_intercept(ln(l_extendedprice / (l_quantity * 1500)), -0.25 * l_tax)), regr_slope(ln(l_extendedprice / (l_quantity * 1500)), -0.25 * l_tax)] as c from b where l_extendedprice > 1)""")
def anisotropic_scale(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("fo"), (F.col("l_quantity") * 1500).alias("fc"), "l_tax")
    r = scaling.anisotropic_scale(li, "fo", "fc", {"b": F.col("l_tax")})
    return spark.createDataFrame([(round(r["k"], 4), round(r["b"], 6))], "k double, b double")


@query()
def isosurface(spark, sf_dir):
    ship_package(spark)
    return grid.isosurface(grid.normalized(_grid(spark, sf_dir)), 1.5, (16, 16, 16))


@query()
def moving_superposition(spark, sf_dir):
    ship_package(spark)
    p = points(spark, sf_dir).withColumn("chain", F.col("label").cast("string"))
    pairs = p.select("chain", F.col("serial").alias("ord"), "x", "y", "z", F.col("y").alias("x_2"), F.col("z").alias("y_2"), F.col("x").alias("z_2")).where("chain is not null")
    return rounded(structure.moving_superposition(pairs, 6.0), "rmsd")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
