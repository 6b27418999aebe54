"""Quality rules: base counts of a text, and the Jensen-Shannon distance of its histograms from language references.

Only built-in expressions run here. The references are fitted once, on a set of documents that are known to be good, and
kept: numbers of a fixed size. One pass over the texts then makes a small row a document (counts and two histograms), which
is held against them; a verdict depends on its text and the references alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, ship_package, stored

# Frequent function words of four languages.
COMMON = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"],
    "en": ["the", "of", "and", "to", "a", "in", "that", "is", "was", "for", "on", "with"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "dans"],
}
SYMBOLS = "#*$%&|<>"
#: Below so many words a histogram says too little, and its test is passed; so many make a text serve as a reference.
MIN_WORDS_CLASSES, MIN_WORDS_COMMON = 50, 200
#: Jensen-Shannon distance (base 2, 0 to 1) of classes above which a text is rejected, with 1.9 / sqrt(characters) more, as a short text strays by chance.
MAX_CLASSES = 0.13
#: The limit of the common-word distance from MIN_WORDS_CLASSES words on: a fixed part, and a part over sqrt(words) as a short text strays by
#: chance (about 1.5 / sqrt(words) for 12 listed words of 17 %). At 50 words it is 0.269, below the 0.30 of a text without a listed word.
COMMON_FIXED, COMMON_NOISE = 0.17, 0.7
MILLION = 1_000_000
#: Counts of a histogram: character classes; the listed words of a language and all other words.
N_CLASSES, N_COMMON = 6, 13


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _windows(words: Column, n: Column, hashed: Callable[..., Column]) -> Column:
    """Windows of three words, sorted: each is one long, the high bits of its hash over its position.

    The position takes only the bits that the text needs, so the hash keeps 49 bits or more up to 32,768 words.
    """
    heads = F.slice(words, 1, F.greatest(n - 2, F.lit(0)))
    return F.sort_array(F.transform(heads, lambda w, i: F.call_function("shiftleft", hashed(w, words[i + 1], words[i + 2]), _bits(n)).bitwiseOR(i.cast("long"))))


def _bits(n: Column) -> Column:
    return F.ceil(F.log2(n + F.lit(2))).cast("int")


def _covered(starts: Column) -> Column:
    """How many words the windows at these starts cover."""
    return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda x: F.array(x, x + 1, x + 2))))).cast("long")


def _spelt_out(words: Column, n: Column) -> Column:
    """Windows as texts with their starts, sorted: for texts in which hashes collide."""
    heads = F.slice(words, 1, F.greatest(n - 2, F.lit(0)))
    return F.sort_array(F.transform(heads, lambda w, i: F.struct(F.concat_ws(" ", w, words[i + 1], words[i + 2]).alias("w"), i.cast("long").alias("i"))))


def counted(docs: DataFrame, text: str = "text", hashed: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes (6 counts), language and common (13 counts).

    n_repeat_words, the words in windows of three words that occur twice or more, is found by hashes. Windows of equal hashes
    are compared word by word, and where two differ the text is counted again by its words alone, so the count is exact.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    known = sorted({w for words in COMMON.values() for w in words})
    a = docs.withColumn("_t", t).withColumn("_w", words_of(F.col("_t"))).withColumn("n_words", F.size("_w").cast("long"))
    a = a.withColumn("_windows", _windows(F.col("_w"), F.col("n_words"), hashed))
    a = a.withColumn("_known", F.filter("_w", lambda w: w.isin(known)))
    a = a.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda s: s.rlike(WORD)))
    a = a.withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
    a = a.withColumn("n_symbols", F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long"))
    a = a.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    upper, digit, mark = (F.regexp_count("_t", F.lit(p)).cast("long") for p in (r"\p{Lu}", r"\p{Nd}", r"[.,;:!?'\"()\-]"))
    a = a.withColumn("_upper", upper).withColumn("_digit", digit).withColumn("_mark", mark)
    step = F.call_function("shiftleft", F.lit(1).cast("long"), _bits(F.col("n_words")))
    s, near = F.col("_windows"), lambda x, y: (x.bitwiseXOR(y) >= 0) & (x.bitwiseXOR(y) < F.col("_step"))
    a = a.withColumn("_step", step).withColumn("_n", F.size("_windows"))
    a = a.withColumn("_twice", F.filter(s, lambda x, i: ((i > 0) & near(x, F.get(s, i - 1))) | ((i < F.col("_n") - 1) & near(x, F.get(s, i + 1)))))
    at = lambda x: x.bitwiseAND(F.col("_step") - 1)
    word = lambda x, k: F.get("_w", (at(x) + k).cast("int"))
    differ = lambda x, y: (word(x, 0) != word(y, 0)) | (word(x, 1) != word(y, 1)) | (word(x, 2) != word(y, 2))
    twice = F.col("_twice")
    clash = F.size(F.filter(twice, lambda x, i: (i > 0) & near(x, F.get(twice, i - 1)) & differ(x, F.get(twice, i - 1)))) > 0
    a = a.withColumn("_spelt", F.when(clash, _spelt_out(F.col("_w"), F.col("n_words"))))
    alike = lambda x, i: F.coalesce(F.get("_spelt", i)["w"] == x["w"], F.lit(False))
    exact = F.filter("_spelt", lambda x, i: ((i > 0) & alike(x, i - 1)) | alike(x, i + 1))
    a = a.withColumn("n_repeat_words", _covered(F.when(F.col("_spelt").isNull(), F.transform(twice, at)).otherwise(F.transform(exact, lambda x: x["i"]))))
    blanks = F.length("_t") - F.col("word_chars")
    letters = F.col("word_chars") - F.col("_upper") - F.col("_digit") - F.col("_mark") - F.col("n_symbols")
    a = a.withColumn("classes", F.array(letters, "_upper", "_digit", blanks, F.col("_mark"), "n_symbols"))

    def hits_of(listed: list[str]) -> Column:
        return F.size(F.filter("_known", lambda w: w.isin(listed)))

    hits = [F.struct(hits_of(listed).alias("hits"), F.lit(k).alias("language")) for k, listed in COMMON.items()]
    best = F.array_max(F.array(*hits))
    a = a.withColumn("language", F.when(best["hits"] > 0, best["language"]))
    lists = F.create_map(*(x for k, ws in COMMON.items() for x in (F.lit(k), F.array(*map(F.lit, ws)))))
    none = F.array_repeat(F.lit(""), N_COMMON - 1)  # no word is empty: all of the text is in the last count
    chosen = F.coalesce(F.element_at(lists, F.col("language")), none)
    a = a.withColumn("_listed", F.transform(chosen, lambda x: F.size(F.filter("_known", lambda w: w == x)).cast("long")))
    total = F.aggregate("_listed", F.lit(0).cast("long"), lambda x, y: x + y)
    a = a.withColumn("common", F.concat("_listed", F.array(F.col("n_words") - total)))
    return a.drop("_t", "_w", "_windows", "_known", "_lines", "_upper", "_digit", "_mark", "_step", "_n", "_twice", "_spelt", "_listed")


def shares(counts: Column) -> Column:
    """Millionths of the total, whole numbers, so that sums do not depend on their order."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda x, y: x + y)
    return F.transform(counts, lambda x: F.floor((x * MILLION + F.floor(total / 2)) / F.greatest(total, F.lit(1))).cast("long"))


def _normal(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda x, y: x + y)
    return F.transform(counts, lambda x: x / F.greatest(total, F.lit(1)))


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of shares that sum to 1."""

    def part(x: Column, y: Column) -> Column:
        one = lambda z: F.when(z > 0, z * F.log2(2 * z / (x + y))).otherwise(F.lit(0.0))
        return (one(x) + one(y)) / 2

    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(p, q, part), F.lit(0.0), lambda x, y: x + y)))


#: Of each language, and of all together under None: the mean shares of character classes and of common words.
References = dict[str | None, tuple[list[float], list[float]]]


def fitted(docs: DataFrame, text: str = "text") -> References:
    """References from a set of good documents: the mean shares of those that have a language and MIN_WORDS_COMMON words.

    Four languages and their total are collected, 19 numbers each; without a document that serves there are none.
    """
    ship_package(docs.sparkSession)
    rows = counted(docs.select(F.col(text).alias("_text")), "_text")
    return _means(rows.select("language", "n_words", shares(F.col("classes")).alias("classes"), shares(F.col("common")).alias("common")))


def _means(rows: DataFrame) -> References:
    # No filter: it would be pushed below the counts, which it would copy.
    serves = F.when(F.col("n_words") >= MIN_WORDS_COMMON, F.col("language")).alias("language")
    sums = lambda name, n: F.array(*[F.sum(F.get(name, F.lit(i))) for i in range(n)]).alias(name)
    found = {r.language: (r.classes, r.common) for r in rows.groupBy(serves).agg(sums("classes", N_CLASSES), sums("common", N_COMMON)).collect()}
    found.pop(None, None)
    if found:
        found[None] = tuple([sum(x) for x in zip(*(v[i] for v in found.values()), strict=True)] for i in (0, 1))
    return {k: tuple([x / sum(part) for x in part] for part in v) for k, v in sorted(found.items(), key=lambda x: x[0] or "")}


def judged(docs: DataFrame, keep: list[str], text: str = "text", references: References | None = None) -> DataFrame:
    """keep columns of docs and the verdict: the base counts, base_failed, language, class_distance, common_distance, kept.

    references come from fitted() on documents known to be good; without them they are fitted on the documents of docs that
    pass the base rules, and a verdict then depends on what else docs holds. A text without a listed word has no language:
    it is held against the mean of all references' classes, and its words, all of them others, against the nearest
    reference. Common words are measured from MIN_WORDS_CLASSES words on, against a limit that narrows with length. A text
    of a language without a reference is held against the mean's classes alone. A null or empty text has zero counts and
    fails the base rules. Rows that repeat are judged each, and alike. A very long text is judged whole, in one task. Columns
    that keep does not name are ignored, whatever their names. With an empty table nothing is returned; without any reference
    the base rules decide alone.
    """
    ship_package(docs.sparkSession)
    names = [f"_keep{i}" for i in range(len(keep))]
    only = docs.select(*(F.col(f"`{k}`").alias(n) for k, n in zip(keep, names, strict=True)), F.col(text).alias("_text"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = counted(only, "_text").withColumn("base_failed", failed)
    rows = stored(rows.select(*names, *counts, "base_failed", "language", shares(F.col("classes")).alias("classes"), shares(F.col("common")).alias("common")), "quality-rows")
    if references is None:
        references = _means(rows.where("not base_failed"))
    array = lambda xs: F.array(*map(F.lit, xs))
    of = lambda i, kind: F.element_at(F.create_map(*(x for k, v in references.items() if k for x in (F.lit(k), array(v[i])))), F.col("language")) if references else F.lit(None).cast(kind)
    none = F.lit(None).cast("array<double>")
    overall = array(references[None][0]) if references else none
    others = F.array(*[F.lit(0.0)] * (N_COMMON - 1), F.lit(1.0))
    nearest = F.least(*(_distance(others, array(v[1])) for v in references.values()), F.lit(1.0)) if references else F.lit(None).cast("double")
    long_enough = F.col("n_words") >= MIN_WORDS_CLASSES
    both = rows.withColumn("class_distance", F.when(long_enough, _distance(_normal(F.col("classes")), F.coalesce(of(0, "array<double>"), overall))))
    words_distance = F.when(F.col("language").isNotNull(), _distance(_normal(F.col("common")), of(1, "array<double>"))).otherwise(nearest)
    both = both.withColumn("common_distance", F.when(long_enough, words_distance))
    classes_pass = F.coalesce("class_distance", F.lit(0.0)) <= MAX_CLASSES + 1.9 / F.sqrt(F.greatest(F.col("word_chars"), F.lit(1)))
    words_pass = F.coalesce("common_distance", F.lit(0.0)) <= COMMON_FIXED + COMMON_NOISE / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    both = both.withColumn("kept", ~F.col("base_failed") & classes_pass & words_pass)
    return both.select(*(F.col(n).alias(k) for k, n in zip(keep, names, strict=True)), *counts, "base_failed", "kept", "language", "class_distance", "common_distance")
