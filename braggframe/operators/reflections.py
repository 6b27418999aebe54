"""Reflection tables: merging, shell statistics, bins, normalisation, comparison, generation, scaling.

Tables have h, k, l (int) and named value columns. A row's group is its (h, k, l, isign): all statistics are sums that
Spark combines before its shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import stored

from ..functions.cell import Cell
from ..functions.symmetry import Group

HKL = ["h", "k", "l"]


def prepared(df: DataFrame, group: Group, anomalous: bool = True) -> DataFrame:
    """Unmerged rows (h, k, l, value, sigma) mapped to the asymmetric unit; isign +1 or -1, 0 for means, +1 for centric ones."""
    valid = df.where(F.col("value").isNotNull() & (F.col("sigma") > 0)).withColumn("_asu", group.to_asu(F.col("h"), F.col("k"), F.col("l")))
    sign = F.when(F.col("_asu.isym") % 2 == 1, 1).otherwise(-1) if anomalous else F.lit(0)
    others = [c for c in valid.columns if c not in (*HKL, "_asu")]
    out = valid.select(*(F.col(f"_asu.{c}").alias(c) for c in HKL), sign.alias("isign"), *others)
    if anomalous:
        centric = group.is_centric(F.col("h"), F.col("k"), F.col("l"))
        out = out.withColumn("isign", F.when(centric, 1).otherwise(F.col("isign")))
    return out


def merged(df: DataFrame, keys: list[str]) -> DataFrame:
    """Inverse-variance means: value, sigma and nobs of each group. Rows without a value or a positive sigma are left out."""
    w = 1 / (F.col("sigma") * F.col("sigma"))
    valid = df.where(F.col("value").isNotNull() & (F.col("sigma") > 0))
    return valid.groupBy(*keys).agg((F.sum(w * F.col("value")) / F.sum(w)).alias("value"), (1 / F.sqrt(F.sum(w))).alias("sigma"), F.count("*").alias("nobs"))


def group_sums(df: DataFrame, keys: list[str], shell: str, weights: str = "Y") -> DataFrame:
    """Per group: n, sum of values, mean, sum of absolute deviations from the mean, weighted second moment.

    weights U: every observation counts 1; else 1 / sigma squared. One shuffle: the window and the sums share its keys.
    """
    w = F.lit(1.0) if weights == "U" else 1 / (F.col("sigma") * F.col("sigma"))
    over = W.partitionBy(*dict.fromkeys([shell, *keys]))
    rows = df.where(F.col("value").isNotNull() & (F.col("sigma") > 0)).withColumn("_w", w)
    rows = rows.withColumn("_mean", F.sum(F.col("_w") * F.col("value")).over(over) / F.sum("_w").over(over))
    v = F.col("value")
    return rows.groupBy(*dict.fromkeys([shell, *keys])).agg(
        F.count("*").alias("n"), F.sum(v).alias("sum_i"), F.first("_mean").alias("mean"), F.sum(F.abs(v - F.col("_mean"))).alias("dev"),
        (F.sum(F.col("_w") * v * v) / F.sum("_w")).alias("mean_sq"),
    )


def merging_sums(df: DataFrame, keys: list[str], shell: str, weights: str = "Y") -> DataFrame:
    """Mergeable sums of each shell; add them over shells or files to combine statistics."""
    g = group_sums(df, keys, shell, weights)
    many = F.col("n") > 1
    of = lambda x: F.sum(F.when(many, x))
    n, dev, mean = F.col("n"), F.col("dev"), F.col("mean")
    below = n * mean if weights == "Y" else F.col("sum_i")
    noise = 2 * (F.col("mean_sq") - mean * mean) / (n - 1)
    return g.groupBy(shell).agg(
        F.sum("n").alias("all_refl"), F.count("*").alias("unique_refl"), F.count(F.when(many, 1)).alias("stats_refl"),
        of(dev).alias("s_merge"), of(dev * F.sqrt(n / (n - 1))).alias("s_meas"), of(dev * F.sqrt(1 / (n - 1))).alias("s_pim"), of(below).alias("s_below"),
        of(mean).alias("s_mean"), of(mean * mean).alias("s_mean2"), of(noise).alias("s_noise"),
    )


def merging_statistics(sums: DataFrame) -> DataFrame:
    """R-merge, R-meas, R-pim, CC1/2 by the sigma-tau method, CC* from merging_sums."""
    n = F.col("stats_refl")
    var = (F.col("s_mean2") - F.col("s_mean") * F.col("s_mean") / n) / (n - 1)
    noise = F.col("s_noise") / n
    cc = F.when(n > 1, (var - noise / 2) / (var + noise / 2))
    r = lambda c: F.when(F.col("s_below") != 0, F.col(c) / F.col("s_below"))
    keep = [c for c in sums.columns if not c.startswith("s_")]
    return sums.select(*keep, r("s_merge").alias("r_merge"), r("s_meas").alias("r_meas"), r("s_pim").alias("r_pim"), cc.alias("cc_half")).withColumn("cc_star", F.when(F.col("cc_half") > -1, F.sqrt(F.greatest(F.lit(0.0), 2 * F.col("cc_half") / (1 + F.col("cc_half"))))))


def take_average(stats: DataFrame, column: str) -> Column:
    return F.sum(F.col(column) * F.col("stats_refl")) / F.sum(F.when(F.col(column).isNotNull(), F.col("stats_refl")))


# Bins: n upper limits, x <= limit belongs, the last one open.


def bin_limits(df: DataFrame, x: str, nbins: int, method: str = "equalcount") -> DataFrame:
    """A row a bin: bin (from 0), mid and limit (1/d squared). equalcount: exact ranks; dstar, dstar2, dstar3: even in d*, d*2, d*3.

    Ranks are a range-partitioned sort and per-part offsets, not a window over one partition.
    """
    spark = df.sparkSession
    half = spark.range(1, 2 * nbins + 1).select(F.col("id").cast("int").alias("i"))
    if method == "equalcount":
        r = exact_ranks(df.select(x).where(F.col(x).isNotNull()), x)
        total = r.agg(F.count("*").alias("n"))
        wanted = half.where(F.col("i") < 2 * nbins).crossJoin(F.broadcast(total)).select("i", F.least(F.floor(F.col("n") / F.lit(2.0 * nbins) * F.col("i")).cast("long"), F.col("n") - 1).alias("_rank"))
        found = r.join(F.broadcast(wanted), "_rank").select("i", F.col(x).alias("limit"))
        found = half.join(F.broadcast(found), "i", "left")
    else:
        power = {"dstar2": 1.0, "dstar": 0.5, "dstar3": 1.5}[method]
        ends = df.agg(F.pow(F.min(x), power).alias("lo"), F.pow(F.max(x), power).alias("hi"))
        found = half.crossJoin(F.broadcast(ends)).select("i", F.when(F.col("i") < 2 * nbins, F.pow(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (2 * nbins), 1 / power)).alias("limit"))
    return found.groupBy(F.floor((F.col("i") - 1) / 2).cast("int").alias("bin")).agg(F.max(F.when(F.col("i") % 2 == 1, F.col("limit"))).alias("mid"), F.coalesce(F.max(F.when(F.col("i") % 2 == 0, F.col("limit"))), F.lit(float("inf"))).alias("limit"))


def exact_ranks(df: DataFrame, x: str) -> DataFrame:
    """Adds _rank from 0 in the order of x: sort within ranges, then offsets from a row a range.

    The ranges are stored, once: range bounds are sampled, and counts and rows read apart would belong to other ones.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.repartitionByRange(parts, x).withColumn("_part", F.spark_partition_id()), "ranges")
    placed = ranged.withColumn("_in", F.row_number().over(W.partitionBy("_part").orderBy(x)) - 1)
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row a range
    return placed.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn("_rank", (F.col("_in") + F.col("_before")).cast("long")).drop("_part", "_in", "_before")


def with_bin(df: DataFrame, limits: DataFrame, x: Column | str, name: str = "bin") -> DataFrame:
    """Adds the bin of x: the number of limits below it."""
    x = F.col(x) if isinstance(x, str) else x
    edges = limits.agg(F.array_sort(F.collect_list("limit")).alias("_limits"))  # as many as bins
    return df.crossJoin(F.broadcast(edges)).withColumn(name, F.size(F.filter("_limits", lambda e: e < x))).drop("_limits")


def bin_mean(df: DataFrame, bins: str, value: str) -> DataFrame:
    return df.groupBy(bins).agg(F.avg(F.nanvl(F.col(value).cast("double"), F.lit(None))).alias("mean"))


def bin_rfactor(df: DataFrame, bins: str, obs: str, calc: str, riso: bool = False) -> DataFrame:
    below = (F.col(obs) + F.col(calc)) / 2 if riso else F.col(obs)
    ok = F.col(obs).isNotNull() & F.col(calc).isNotNull()
    return df.where(ok).groupBy(bins).agg((F.sum(F.abs(F.col(obs) - F.col(calc))) / F.sum(below)).alias("rfactor"))


def bin_correlation(df: DataFrame, bins: str, obs: str, calc: str) -> DataFrame:
    return df.where(F.col(obs).isNotNull() & F.col(calc).isNotNull()).groupBy(bins).agg(correlation(obs, calc).alias("cc"), F.count("*").alias("n"))


def correlation(x: str, y: str) -> Column:
    """Pearson's, null where a side is constant."""
    return F.nullif(F.corr(x, y), F.lit(float("nan")))


def normalizers(df: DataFrame, bins: str, f: str, epsilon: str) -> DataFrame:
    """Root mean square of F / sqrt(epsilon) of a bin, smoothed with weights .75, 1, .75 over its neighbours."""
    per = df.where(F.col(f).isNotNull()).groupBy(bins).agg(F.sum(F.col(f) * F.col(f) / F.col(epsilon)).alias("_s"), F.count("*").alias("_n"))
    w = W.orderBy(bins)  # a row a bin
    k = 0.75
    mean = F.col("_s") / F.col("_n")
    side = lambda g: F.coalesce(k * g(mean).over(w), F.lit(0.0))
    there = lambda g: F.when(g(mean).over(w).isNotNull(), k).otherwise(0.0)
    lag, lead = (lambda c: F.lag(c)), (lambda c: F.lead(c))
    return per.select(bins, F.sqrt((side(lag) + mean + side(lead)) / (there(lag) + 1.0 + there(lead))).alias("normalizer"))


def e_values(df: DataFrame, bins: str, f: str, epsilon: str) -> DataFrame:
    n = normalizers(df, bins, f, epsilon)
    return df.join(F.broadcast(n), bins, "left").withColumn("e", F.col(f) / F.sqrt(epsilon) / F.col("normalizer")).drop("normalizer")


# Tables against tables.


def matched(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Rows of equal keys side by side; values of b are suffixed _2."""
    right = b.select(*keys, *(F.col(c).alias(f"{c}_2") for c in b.columns if c not in keys))
    return a.join(right, keys, how)


def copied_column(a: DataFrame, b: DataFrame, keys: list[str], column: str, name: str | None = None) -> DataFrame:
    """a with a column of b by matching keys, null where missing."""
    return a.join(b.groupBy(*keys).agg(F.first(column).alias(name or column)), keys, "left")


def compared(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float = 0.0) -> DataFrame:
    """Row differences: status is only_1, only_2, differs or same."""
    j = a.select(*keys, F.col(value).alias("v1"), F.lit(True).alias("_a")).join(b.select(*keys, F.col(value).alias("v2"), F.lit(True).alias("_b")), keys, "full_outer")
    same = F.col("v1").eqNullSafe(F.col("v2")) | (F.abs(F.col("v1") - F.col("v2")) <= tolerance)
    status = F.when(F.col("_b").isNull(), "only_1").when(F.col("_a").isNull(), "only_2").when(F.coalesce(same, F.lit(False)), "same").otherwise("differs")
    return j.select(*keys, "v1", "v2", status.alias("status"))


def complex_correlation(df: DataFrame, f1: str, phi1: str, f2: str, phi2: str) -> Column:
    """Real part of the correlation of two sets of phased amplitudes (degrees), about their means."""
    re = lambda f, p: F.col(f) * F.cos(F.radians(p))
    im = lambda f, p: F.col(f) * F.sin(F.radians(p))
    n = F.count("*")
    a, b, c, d = re(f1, phi1), im(f1, phi1), re(f2, phi2), im(f2, phi2)
    cov = F.sum(a * c + b * d) - (F.sum(a) * F.sum(c) + F.sum(b) * F.sum(d)) / n
    v1 = F.sum(a * a + b * b) - (F.sum(a) * F.sum(a) + F.sum(b) * F.sum(b)) / n
    v2 = F.sum(c * c + d * d) - (F.sum(c) * F.sum(c) + F.sum(d) * F.sum(d)) / n
    return cov / F.sqrt(v1 * v2)


def column_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row a column: count, filled percentage, min, max, mean and population deviation over values that are not missing."""
    v = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    structs = [F.struct(F.lit(c).alias("column"), F.count(v(c)).alias("n"), (100.0 * F.count(v(c)) / F.count("*")).alias("filled"), F.min(v(c)).alias("min"), F.max(v(c)).alias("max"), F.avg(v(c)).alias("mean"), F.stddev_pop(v(c)).alias("rms")) for c in columns]
    return df.agg(F.array(*structs).alias("s")).select(F.inline("s"))


def data_type(df: DataFrame, group: Group) -> DataFrame:
    """One row: unique reflections, and Mean, Anomalous or Unmerged by what stands twice under symmetry."""
    a = df.select(group.to_asu(F.col("h"), F.col("k"), F.col("l")).alias("a"))
    signs = a.groupBy("a.h", "a.k", "a.l").agg(F.count("*").alias("n"), F.countDistinct(F.col("a.isym") % 2).alias("signs"))
    twice = F.max(F.col("n") - F.col("signs"))
    return signs.agg(F.count("*").alias("unique_refl"), F.when(twice > 0, "Unmerged").when(F.max("signs") > 1, "Anomalous").otherwise("Mean").alias("data_type"))


# Generation.


def all_reflections(spark, cell: Cell, group: Group, d_min: float, d_max: float = 0.0, unique: bool = True) -> DataFrame:
    """hkl with d_min <= d < d_max in the asymmetric unit, without systematic absences (unless not unique)."""
    from ..functions.symmetry import asu_condition

    h, k, l = cell.hkl_limits(d_min)
    axis = lambda n, name: spark.range(-n, n + 1).select(F.col("id").cast("int").alias(name))
    grid = axis(h, "h").crossJoin(F.broadcast(axis(k, "k"))).crossJoin(F.broadcast(axis(l, "l")))  # ranges of the cell's edges over d_min
    x, y, z = F.col("h"), F.col("k"), F.col("l")
    inv = cell.inv_d2(x, y, z)
    keep = (inv <= 1 / d_min**2) & ((x != 0) | (y != 0) | (z != 0))
    if d_max > 0:
        keep &= inv > 1 / d_max**2
    if unique:
        keep &= asu_condition(group)(x, y, z) & ~group.is_absent(x, y, z)
    return grid.where(keep)


def completeness(df: DataFrame, unique: DataFrame) -> DataFrame:
    have = df.select(*HKL).distinct().withColumn("_have", F.lit(1))
    return unique.join(have, HKL, "left").agg(F.count("*").alias("possible"), F.count("_have").alias("measured"), (F.count("_have") / F.count("*")).alias("completeness"))


def expanded_to_p1(df: DataFrame, group: Group, phase: str | None = None) -> DataFrame:
    """All equivalents but Friedel mates of those present; phases (degrees) are shifted."""
    e = df.withColumn("_eq", F.explode(group.equivalents(F.col("h"), F.col("k"), F.col("l"))))
    e = e.withColumn("_row", F.struct(*HKL))
    for c in HKL:
        e = e.withColumn(c, F.col(f"_eq.{c}"))
    if phase:
        e = e.withColumn(phase, F.pmod(F.col(phase) + F.col("_eq.shift"), F.lit(360.0)))
    mate = F.when((F.col("h") < 0) | ((F.col("h") == 0) & ((F.col("k") < 0) | ((F.col("k") == 0) & (F.col("l") < 0)))), F.struct((-F.col("h")).alias("h"), (-F.col("k")).alias("k"), (-F.col("l")).alias("l"))).otherwise(F.struct(*HKL))
    first = W.partitionBy("_row", mate).orderBy("_eq.op")
    return e.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_eq", "_row", "_n")


def in_asu(df: DataFrame, group: Group, phases: tuple[str, ...] = ()) -> DataFrame:
    """Maps rows to the asymmetric unit; phases move with the operation and change sign for a Friedel mate."""
    a = df.withColumn("_a", group.to_asu(F.col("h"), F.col("k"), F.col("l"))).withColumn("_op", F.floor((F.col("_a.isym") - 1) / 2).cast("int"))
    shift = F.element_at(group.equivalents(F.col("h"), F.col("k"), F.col("l")), F.col("_op") + 1)["shift"]
    a = a.withColumn("_shift", shift)
    for p in phases:
        moved = F.col(p) + F.col("_shift")
        a = a.withColumn(p, F.pmod(F.when(F.col("_a.isym") % 2 == 0, -moved).otherwise(moved), F.lit(360.0)))
    for c in HKL:
        a = a.withColumn(c, F.col(f"_a.{c}"))
    return a.withColumn("isym", F.col("_a.isym")).drop("_a", "_op", "_shift")


def reindexed(df: DataFrame, op) -> DataFrame:
    from ..functions.symmetry import hkl_under

    h, k, l = (x.cast("int") for x in hkl_under(op, F.col("h"), F.col("k"), F.col("l")))
    return df.withColumns({"h": h, "k": k, "l": l})


def by_sigma_ratio(df: DataFrame, cutoff: float) -> DataFrame:
    return df.where((F.col("sigma") > 0) & (F.col("value") > cutoff * F.col("sigma")))


def scale_factors(df: DataFrame, fo: str, fc: str, stol2: Column) -> DataFrame:
    """One row: k and B of Fo ~ k exp(-B s2) Fc by the regression of logarithms, and R after scaling's denominator sums."""
    ok = df.where((F.col(fo) > 1) & (F.col(fc) > 0)).select(F.log(F.col(fo) / F.col(fc)).alias("y"), stol2.alias("x"))
    return ok.agg(F.exp(F.regr_intercept("y", "x")).alias("k"), (-F.regr_slope("y", "x")).alias("b"), F.count("*").alias("n"))


def r_factor(fo: str, fc: str) -> Column:
    return F.sum(F.abs(F.col(fo) - F.col(fc))) / F.sum(fo)
