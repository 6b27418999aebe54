"""Queries over CIF items (see sources.cif): lookup, tables, grep, statistics, differences, dictionary checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.values import cif_number, cif_string, glob_pattern, is_null
from ..storage import small

BLOCK = ["path", "block_idx", "block"]


def find_values(items: DataFrame, tag: str) -> DataFrame:
    """All values of a tag, whatever its case, in order."""
    return items.where(F.lower("tag") == tag.lower()).where("value_raw is not null")


def find_value(items: DataFrame, tag: str) -> DataFrame:
    """The value of a pair, or of a loop of one row: a row a block."""
    one = find_values(items, tag).groupBy(*BLOCK).agg(F.max("row_idx").alias("_last"), F.min_by("value_raw", "row_idx").alias("value_raw"))
    return one.where("_last = 0").drop("_last")


def find_table(items: DataFrame, prefix: str, tags: list[str]) -> DataFrame:
    """Columns of one loop, or pairs as one row; ?tag is optional. Blocks that lack a tag, or have them in different loops, give nothing."""
    names = [(t.lstrip("?"), t.startswith("?")) for t in tags]
    if names[0][1]:
        raise ValueError("the first tag cannot be optional")
    full = [(prefix + n, opt) for n, opt in names]
    rows = items.where(F.lower("tag").isin([t.lower() for t, _ in full])).where("value_raw is not null")
    need = [t.lower() for t, opt in full if not opt]
    per_loop = F.when(F.col("kind") == "loop", F.col("item_idx")).otherwise(F.lit(-1))
    rows = rows.withColumn("_loop", per_loop)
    picks = [F.max(F.when(F.lower("tag") == t.lower(), F.col("value_raw"))).alias(t) for t, _ in full]
    table = rows.groupBy(*BLOCK, "_loop", "row_idx").agg(*picks, F.count_if(F.lower("tag").isin(need)).alias("_have"))
    return table.where(F.col("_have") == len(need)).drop("_have", "_loop")


def category(items: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """An mmCIF category as a table of raw values; missing columns are null."""
    name = name.strip("_.")
    rows = items.where((F.lower("category") == name.lower()) & F.col("value_raw").isNotNull())
    picks = [F.max(F.when(F.lower("tag") == f"_{name}.{c}".lower(), F.col("value_raw"))).alias(c) for c in columns]
    return rows.groupBy(*BLOCK, "row_idx").agg(*picks)


def category_names(items: DataFrame) -> DataFrame:
    return items.where("category <> ''").groupBy(*BLOCK, "category").agg(F.min("item_idx").alias("item_idx"))


def with_pair(items: DataFrame, tag: str, value: str) -> DataFrame:
    """Sets a pair in every block: replaced where present, else added at the end."""
    low = tag.lower()
    kept = items.withColumn("value_raw", F.when((F.lower("tag") == low) & (F.col("kind") == "pair"), F.lit(value)).otherwise(F.col("value_raw")))
    ends = items.groupBy(*BLOCK).agg((F.max("item_idx") + 1).alias("item_idx"), F.max(F.lower("tag") == low).alias("_has"))
    new = ends.where(~F.coalesce("_has", F.lit(False)) & F.col("block").isNotNull()).select(*BLOCK, F.lit(None).cast("string").alias("frame"), "item_idx", F.lit("pair").alias("kind"), F.lit(tag[1:].split(".")[0] if "." in tag else "").alias("category"), F.lit(tag).alias("tag"), F.lit(0).alias("row_idx"), F.lit(0).alias("col_idx"), F.lit(value).alias("value_raw"))
    return kept.unionByName(new, allowMissingColumns=True)


def without(items: DataFrame, prefix: str) -> DataFrame:
    return items.where(~F.coalesce(F.lower("tag").startswith(prefix.lower()), F.lit(False)))


def duplicates(items: DataFrame) -> DataFrame:
    """Tags that stand twice in a block or frame, whatever their case."""
    at = F.struct("item_idx", "col_idx")
    return items.where("tag is not null").groupBy(*BLOCK, "frame", F.lower("tag").alias("tag")).agg(F.countDistinct(at).alias("n")).where("n > 1")


def grep(items: DataFrame, pattern: str, mode: str = "tag", raw: bool = False, max_per_file: int | None = None) -> DataFrame:
    """Values of matching tags with file, block and line. mode: tag (exact), glob or regex; nulls are left out unless raw."""
    tag = F.col("tag")
    test = tag == pattern if mode == "tag" else tag.rlike(f"(?i){glob_pattern(pattern)}" if mode == "glob" else pattern)
    hits = items.where(test & F.col("value_raw").isNotNull())
    if not raw:
        hits = hits.where(~is_null(F.col("value_raw"))).withColumn("value", cif_string(F.col("value_raw")))
    if max_per_file is not None:
        w = W.partitionBy("path").orderBy("block_idx", "item_idx", "row_idx", "col_idx")
        hits = hits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max_per_file).drop("_n")
    return hits


def grep_and(items: DataFrame, first: str, others: list[str]) -> DataFrame:
    """Rows of the first tag with the other tags' values of the same row, or their first value where they are shorter."""
    a = items.where((F.col("tag") == first) & ~is_null(F.col("value_raw"))).select(*BLOCK, "row_idx", F.col("value_raw").alias(first))
    for t in others:
        b = items.where((F.col("tag") == t) & F.col("value_raw").isNotNull())
        here = b.select(*BLOCK, "row_idx", F.col("value_raw").alias("_here"))
        top = b.where("row_idx = 0").select(*BLOCK, F.col("value_raw").alias("_top"))
        a = a.join(here, [*BLOCK, "row_idx"], "left").join(top, BLOCK, "left").withColumn(t, F.coalesce("_here", "_top")).drop("_here", "_top")
    return a


def files_with(items: DataFrame, tag: str, present: bool = True) -> DataFrame:
    has = items.groupBy("path").agg(F.max(F.coalesce(F.col("tag") == tag, F.lit(False))).alias("has"))
    return has.where(F.col("has") == present).select("path")


def value_class(value: Column) -> Column:
    v = cif_string(value)
    return F.when(cif_number(value).isNotNull(), "number").when(v.contains("\n"), "text").when(v.rlike(r"\s"), "line").otherwise("word")


def tag_statistics(items: DataFrame) -> DataFrame:
    """Per tag: blocks, files, values, least and most values a block, numbers' range, counts of the classes number, word, line, text."""
    v = items.where("value_raw is not null").where(~is_null(F.col("value_raw")))
    v = v.withColumns({"_c": value_class(F.col("value_raw")), "_x": cif_number(F.col("value_raw"))})
    per = v.groupBy("tag", *BLOCK).agg(F.count("*").alias("n"), *(F.count_if(F.col("_c") == c).alias(c) for c in ("number", "word", "line", "text")), F.min("_x").alias("x0"), F.max("_x").alias("x1"))
    return per.groupBy("tag").agg(F.count("*").alias("blocks"), F.countDistinct("path").alias("files"), F.sum("n").alias("total"), F.min("n").alias("min_count"), F.avg("n").alias("avg_count"), F.max("n").alias("max_count"), *(F.sum(c).alias(f"n_{c}") for c in ("number", "word", "line", "text")), F.min("x0").alias("min_value"), F.max("x1").alias("max_value"))


def top_values(df: DataFrame, key: str, value: str, k: int = 10) -> DataFrame:
    """The k most frequent values of each key, ties by value."""
    n = df.groupBy(key, value).agg(F.count("*").alias("n"))
    w = W.partitionBy(key).orderBy(F.desc("n"), value)
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Values that differ or stand on one side only, by block name, tag and row."""
    key = ["block", "tag", "row_idx"]
    left = a.where("value_raw is not null").select(*key, F.col("value_raw").alias("v1"))
    right = b.where("value_raw is not null").select(*key, F.col("value_raw").alias("v2"))
    return left.join(right, key, "full_outer").where(~F.col("v1").eqNullSafe(F.col("v2")))


# Dictionary checks. rules: tag, type_regex, enumeration (array), low, high, mandatory (boolean).


def check_values(items: DataFrame, rules: DataFrame) -> DataFrame:
    """The first bad value of each column: unknown tags, types, enumerations and ranges (open ones, or equality at a point)."""
    rule = small(rules.withColumn("_tag", F.lower("tag")).drop("tag"))
    j = items.where("value_raw is not null").withColumn("_tag", F.lower("tag")).join(rule.withColumn("_known", F.lit(True)), "_tag", "left")
    v, x = cif_string(F.col("value_raw")), cif_number(F.col("value_raw"))
    in_range = (F.col("low").isNull() | (x > F.col("low")) | ((F.col("low") == F.col("high")) & (x == F.col("low")))) & (F.col("high").isNull() | (x < F.col("high")) | ((F.col("low") == F.col("high")) & (x == F.col("low"))))
    ranged = F.col("low").isNotNull() | F.col("high").isNotNull()
    problem = (
        F.when(F.col("_known").isNull(), "unknown tag").when(is_null(F.col("value_raw")), None)
        .when(F.col("type_regex").isNotNull() & ~F.coalesce(F.regexp_like(v, F.concat(F.lit("^(?:"), F.col("type_regex"), F.lit(")$"))), F.lit(True)), "type")
        .when(F.col("enumeration").isNotNull() & ~F.array_contains(F.col("enumeration"), v), "enumeration")
        .when(ranged & ~F.coalesce(in_range, F.lit(False)), "range")
    )
    bad = j.withColumn("problem", problem).where("problem is not null")
    w = W.partitionBy(*BLOCK, "frame", "tag").orderBy("row_idx")
    return bad.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*BLOCK, "tag", "row_idx", "value_raw", "problem", "line_no")


def check_mandatory(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Mandatory tags that a block lacks although it has their category."""
    cats = items.where("category <> ''").select(*BLOCK, F.lower("category").alias("_cat")).distinct()
    must = rules.where("mandatory").select("tag", F.lower(F.split_part(F.substring("tag", 2, 1000), F.lit("."), F.lit(1))).alias("_cat"), F.lower("tag").alias("_tag"))
    have = items.where("tag is not null").select(*BLOCK, F.lower("tag").alias("_tag")).distinct()
    return cats.join(must, "_cat").join(have, [*BLOCK, "_tag"], "left_anti").select(*BLOCK, "tag")


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def check_parents(child: DataFrame, child_keys: list[str], parent: DataFrame, parent_keys: list[str]) -> DataFrame:
    """Child keys that no parent has; rows with only nulls are left out, single nulls match nulls."""
    some = F.coalesce(*(F.col(c).cast("string") for c in child_keys)).isNotNull()
    p = parent.select(*(F.col(k).alias(f"_p{i}") for i, k in enumerate(parent_keys))).distinct()
    on = None
    for i, c in enumerate(child_keys):
        t = F.col(c).eqNullSafe(F.col(f"_p{i}"))
        on = t if on is None else on & t
    return child.where(some).join(p, on, "left_anti").select(*child_keys).distinct()
