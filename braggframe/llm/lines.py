"""Line dedup by a segment-partition edit join, with built-in expressions only.

A line is cut into EDITS + 1 segments. If two lines are within EDITS edits, a segment of the shorter (or equal) one
stands unchanged in the other, at one of a few starts that its place and the difference in length allow. Lines are
indexed by (segment number, length, hash of the segment); each line probes the index of every length that can match,
with the substrings at those starts only. Pairs that meet are verified by a bit-parallel automaton over the band of
2 * EDITS + 1 diagonals, after their common ends are cut off.

Lines of at most EDITS code points have no segments: all of them are within EDITS edits of each other, so the one that
stands first is enough to know; a longer line within EDITS edits of one shares a character with it, which is their key.

Lines travel as two hashes and a length; texts are fetched for the lines of candidate pairs alone. Equal lines are
merged before the shuffle, so a line that a third of all documents share is one row a task. A key that more than BLOCK lines
share (a template) is joined in blocks of its index and probe lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, drop_stored, kept, ship_package, small, stored

#: Edits (insertions, deletions, substitutions of code points) up to which two lines are near-duplicates.
EDITS = 2
#: Lines of a key that are joined in one task.
BLOCK = 2000
#: Characters after which the automaton of a pair is looked at.
PROBED = 16


def _with_keys(lines: DataFrame, edits: int) -> DataFrame:
    """A row for each index and probe key of a line: key, indexed. The aligned probes of the line's own length are its index keys.

    For every length that can match, every segment and every start: one row, cut by one expression. An array of all
    keys in one expression would be a method too long for the virtual machine to compile.
    """
    parts = edits + 1
    cuts = [(gap, i, shift) for gap in range(edits + 1) for i in range(parts) for shift in range(max(-i, gap - (edits - i)), min(i, gap + (edits - i)) + 1)]
    cut = lambda gap, i, shift, c: F.struct(gap.alias("gap"), i.alias("i"), shift.alias("shift"), c.alias("char"))
    table = F.array(*(cut(F.lit(gap), F.lit(i), F.lit(shift), F.lit(None).cast("string")) for gap, i, shift in cuts))
    if edits:  # short lines have their characters as keys besides, in the same explosion: the lines are read once
        chars = F.array_distinct(F.filter(F.split("line", ""), lambda c: c != ""))
        short = F.transform(chars, lambda c: cut(F.lit(0), F.lit(0), F.lit(0), c))
        table = F.when(F.col("length") <= 2 * edits, F.concat(table, short)).otherwise(table)
    rows = lines.withColumn("_cut", F.explode(table)).withColumn("_of", F.col("length") - F.col("_cut.gap"))
    # Segments of _of / parts, the last ones a code point longer.
    size, short = F.floor(F.col("_of") / parts).cast("int"), parts - F.col("_of") % parts
    rows = rows.withColumn("_size", size + (F.col("_cut.i") >= short).cast("int")).withColumn("_start", F.col("_cut.i") * size + F.greatest(F.lit(0), F.col("_cut.i") - short) + 1 + F.col("_cut.shift"))
    of_char = F.col("_cut.char").isNotNull()
    rows = rows.where(of_char | ((F.col("_of") >= parts) & (F.col("_start") >= 1) & (F.col("_start") + F.col("_size") <= F.col("length") + 1)))
    key = F.xxhash64(F.substring("line", F.col("_start"), F.col("_size")), F.col("_cut.i"), F.col("_of"))
    key = F.when(of_char, F.xxhash64("_cut.char")).otherwise(key)
    indexed = F.when(of_char, F.col("length") <= edits).otherwise((F.col("_cut.gap") == 0) & (F.col("_cut.shift") == 0))
    return rows.select("h", "g", "length", key.alias("key"), indexed.alias("indexed"))


def _in_blocks(met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Index and probe rows of met, with the block of each key that they meet in: a crowded key's rows in several."""
    n = met.groupBy("key").agg(F.count("*").alias("p"), F.sum(F.col("indexed").cast("long")).alias("i")).where((F.col("p") > BLOCK) & (F.col("i") > 0))
    crowded = stored(n.select("key", F.ceil(F.col("i") / BLOCK).cast("int").alias("_is"), F.ceil(F.col("p") / BLOCK).cast("int").alias("_ps")), "line-crowded", 1)
    rows = met.join(small(crowded, 16), "key", "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("_is", "_ps")})
    own = lambda of: F.pmod(F.xxhash64("g"), of).cast("int")
    all_of = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    i = rows.where("indexed").withColumn("_ib", own("_is")).withColumn("_pb", all_of("_ps"))
    p = rows.withColumn("_pb", own("_ps")).withColumn("_ib", all_of("_is"))
    return i.drop("_is", "_ps"), p.drop("_is", "_ps")


def _common_prefix(a: Column, b: Column, limit: Column) -> Column:
    """Code points that two texts begin with alike, by bisection."""

    def halve(state: Column, _: Column) -> Column:
        mid = F.floor((state["lo"] + state["hi"] + 1) / 2).cast("int")
        same = F.substring(a, F.lit(1), mid) == F.substring(b, F.lit(1), mid)
        return F.struct(F.when(same, mid).otherwise(state["lo"]).alias("lo"), F.when(same, state["hi"]).otherwise(mid - 1).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), limit.cast("int").alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2(limit + 2)).cast("int")), start, halve)["lo"]


def with_near(pairs: DataFrame, a: str, b: str, edits: int) -> DataFrame:
    """Adds near: whether the edit distance of the lines in two columns is at most edits.

    A Levenshtein automaton, bit-parallel over the band. After j characters of b, bit d + edits of level k is set if
    j + d characters of a can be spelt with k edits. Each stage is a column of its own, read more than once by the
    next, so that no stage is evaluated again for every character.
    """
    band = (1 << (2 * edits + 1)) - 1
    level = [f"r{k}" for k in range(edits + 1)]
    x, y = F.col(a), F.col(b)
    out = pairs.withColumn("_head", _common_prefix(x, y, F.least(F.length(x), F.length(y))))
    chars = lambda s: F.filter(F.split(F.substring(s, F.col("_head") + 1, F.length(s)), ""), lambda c: c != "")
    out = out.withColumn("_x", chars(x)).withColumn("_y", chars(y)).withColumn("_gap", F.size("_x") - F.size("_y"))

    def masks(part: Column, skipped: int) -> Column:
        def match(c: Column, j: Column) -> Column:
            bits = [F.when(F.get("_x", j + (skipped + d)) == c, F.lit(1 << (d + edits))).otherwise(F.lit(0)) for d in range(-edits, edits + 1)]
            return sum(bits[1:], bits[0])

        return F.transform(part, match)

    def step(state: Column, mask: Column) -> Column:
        made: list[Column] = []
        for k in range(edits + 1):
            new = state[level[k]].bitwiseAND(mask)
            if k:
                below = state[level[k - 1]]
                new = new.bitwiseOR(below).bitwiseOR(F.shiftright(below, 1)).bitwiseOR(F.shiftleft(made[k - 1], 1).bitwiseAND(F.lit(band)))
            made.append(new)
        return F.struct(*(m.alias(n) for m, n in zip(made, level, strict=True)))

    # Most strangers are dead after a few characters; only what lives then is run to the end.
    start = F.struct(*(F.lit(((1 << (k + 1)) - 1) << edits & band).alias(n) for k, n in enumerate(level)))
    out = out.withColumn("_m", F.when(F.abs("_gap") <= edits, masks(F.slice("_y", 1, PROBED), 0))).withColumn("_s", F.aggregate("_m", start, step))
    alive = F.col("_s").isNotNull() & (F.col(f"_s.{level[-1]}") != 0)
    out = out.withColumn("_m", F.when(alive, masks(F.slice("_y", PROBED + 1, F.greatest(F.size("_y"), F.lit(1))), PROBED)))
    out = out.withColumn("_end", F.aggregate("_m", F.col("_s"), step)[level[-1]])
    near = F.call_function("shiftright", F.col("_end"), F.col("_gap") + edits).bitwiseAND(F.lit(1)) == 1
    return out.withColumn("near", F.coalesce(near, F.lit(False))).drop("_head", "_x", "_y", "_gap", "_m", "_s", "_end")


def _bag(line: Column) -> Column:
    """How often a line holds each of 40 characters."""
    kinds = F.array(*map(F.lit, "abcdefghijklmnopqrstuvwxyz0123456789.,- "))
    return F.transform(kinds, lambda c: F.length(line) - F.length(F.replace(line, c)))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, at (line number from 0), line, length and two hashes, of the lines that hold a word."""
    t = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).where(F.col("line").rlike(WORD))
    return t.select("doc_id", "at", "line", F.length("line").alias("length"), F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"))


def dropped_lines(docs: DataFrame, edits: int = EDITS, min_length: int = 0) -> DataFrame:
    """doc_id and dropped, the numbers of the lines that equal or nearly equal an earlier line; only documents that lose one.

    The order of lines is (doc_id, line number). A line is dropped if its text stands earlier, or if its text is within
    edits of another text that first stands earlier: only texts that come before all their neighbours remain. Lines of fewer
    than min_length code points are compared for equality only; by default all lines are compared for nearness.
    """
    if not 0 <= edits <= 14:
        raise ValueError("from 0 to 14 edits: the automaton's band is kept in the bits of an int")
    spark = docs.sparkSession
    ship_package(spark)
    only = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lines = _lines(only)
    place = F.struct("doc_id", "at")
    firsts = stored(lines.groupBy("h", "g").agg(F.min(place).alias("first"), F.first("length").alias("length"), F.count("*").alias("n")), "line-firsts")
    total, n_lines = firsts.agg(F.count("*"), F.sum("n")).first()  # these bound the tables of one row a text, and a document
    again = stored(firsts.where("n > 1").select("h", "g", "first"), "line-again", total or 0)
    # Of equal lines the first alone is indexed and probes; rows that share its place tie and are merged below.
    once = lines.where(F.col("length") >= min_length).join(small(again, 48), ["h", "g"], "left").where(F.col("first").isNull() | (F.col("first") == place))
    keyed = _with_keys(once, edits)
    # A segment that no other line shares finds nothing: only keys with two lines go on. One exchange by key.
    over = W.partitionBy("key")
    met = keyed.withColumns({"_lo": F.min("h").over(over), "_hi": F.max("h").over(over), "_any": F.max("indexed").over(over)}).where("_lo < _hi and _any").drop("_lo", "_hi", "_any")
    met = kept(met.distinct())  # as many tasks as the exchange has partitions: no file for each
    n_met = met.count()
    wanted = stored(met.select("h", "g").distinct(), "line-wanted", total or 0)
    texts = stored(lines.join(small(wanted, 32), ["h", "g"], "left_semi").groupBy("h", "g").agg(F.first("line").alias("line")).withColumn("bag", _bag(F.col("line"))), "line-texts", total or 0)
    i, p = (side.join(texts.select("h", "g", "bag"), ["h", "g"]).alias(n) for side, n in zip(_in_blocks(met), "ip", strict=True))
    gap = F.col("p.length") - F.col("i.length")
    # An edit changes two counts of a bag by one at most, so bags further apart cannot be within the edits.
    apart = F.aggregate(F.zip_with("i.bag", "p.bag", lambda x, y: F.abs(x - y)), F.lit(0), lambda x, y: x + y)
    other = (F.col("i.h") != F.col("p.h")) | (F.col("i.g") != F.col("p.g"))
    same = (F.col("i.key") == F.col("p.key")) & (F.col("i._ib") == F.col("p._ib")) & (F.col("i._pb") == F.col("p._pb"))
    pairs = i.join(p, same & (gap >= 0) & (gap <= edits) & (F.col("p.length") > edits) & other & (apart <= 2 * edits))
    pairs = stored(pairs.select(F.col("i.h").alias("h"), F.col("i.g").alias("g"), F.col("p.h").alias("h2"), F.col("p.g").alias("g2")).distinct(), "line-pairs", n_met)
    both = pairs.join(texts.select("h", "g", F.col("line").alias("a")), ["h", "g"]).join(texts.select(F.col("h").alias("h2"), F.col("g").alias("g2"), F.col("line").alias("b")), ["h2", "g2"])
    near = stored(with_near(both, "a", "b", edits).select("h", "g", "h2", "g2", "near"), "line-near", pairs.count())  # a filter before the write would copy the automaton into itself
    true = near.where("near").drop("near")
    either = true.union(true.select("h2", "g2", "h", "g"))
    first = firsts.select("h", "g", "first")
    earlier = either.join(first, ["h", "g"]).join(first.select(F.col("h").alias("h2"), F.col("g").alias("g2"), F.col("first").alias("first2")), ["h2", "g2"]).where("first2 < first").select("h", "g")
    # Lines of at most edits code points are all near each other: all but the first text go.
    tiny = firsts.where((F.col("length") <= edits) & (F.col("length") >= min_length))
    least = tiny.agg(F.min("first").alias("_least"))  # one row
    earlier = earlier.union(tiny.join(F.broadcast(least), F.col("first") > F.col("_least")).select("h", "g")).distinct().withColumn("near", F.lit(True))
    # What can lose a line: texts that occur again, and those with an earlier neighbour.
    judged = stored(firsts.join(earlier, ["h", "g"], "left").where("n > 1 or near").select("h", "g", "first", "near"), "line-judged", total or 0)
    hit = lines.drop("line", "length").join(small(judged, 64), ["h", "g"]).where((place != F.col("first")) | F.coalesce("near", F.lit(False)))
    out = stored(hit.groupBy("doc_id").agg(F.sort_array(F.collect_set("at")).alias("dropped")), "line-out", n_lines or 0)
    drop_stored(again, met, pairs, wanted, texts, near, firsts, judged)
    return out


def unused(columns: list[str], name: str) -> str:
    """name with as many underscores as it takes to be none of columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def deduped_lines(docs: DataFrame, edits: int = EDITS, min_length: int = 0) -> DataFrame:
    """docs with text rid of its dropped lines, and n_lines (lines with a word) and n_dropped. Lines without a word stay.

    A null text stays null and an empty one empty. Rows that share a doc_id are read as one document: at the same line
    number they tie, and both keep a first line. Rows without a doc_id come first and are one document too. A document that
    loses every line keeps an empty text or its blank lines. A very long text is a row in one task, read in time in proportion
    to its length. An empty table gives an empty one; other columns stay, but n_lines and n_dropped replace columns of these
    names.
    """
    dropped = dropped_lines(docs, edits, min_length)
    key, gone_at = unused(docs.columns, "lost_id"), unused(docs.columns, "lost")
    lost = small(dropped.select(F.col("doc_id").alias(key), F.col("dropped").alias(gone_at)), 64)
    joined = docs.join(lost, F.col("doc_id").cast("long").eqNullSafe(F.col(f"`{key}`")), "left")
    text = F.col("text").cast("string")
    lines, gone = F.split(text, "\n"), F.coalesce(F.col(f"`{gone_at}`"), F.array().cast("array<int>"))
    words = F.size(F.filter(lines, lambda s: s.rlike(WORD)))
    # The runs of lines between the dropped ones.
    runs = F.zip_with(F.concat(F.array(F.lit(-1)), gone), F.concat(gone, F.array(F.size(lines))), lambda a, b: F.slice(lines, a + 2, b - a - 1))
    left = F.when(F.size(gone) == 0, F.col("text")).otherwise(F.array_join(F.flatten(runs), "\n"))
    own = ("n_lines", "n_dropped")
    counts = (F.when(F.col("text").isNull(), 0).otherwise(words).cast("long").alias(own[0]), F.size(gone).cast("long").alias(own[1]))
    return joined.select(*(left.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns if c.lower() not in own), *counts)
