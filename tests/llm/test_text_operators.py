"""The text operators against brute force, round trips and hard cases: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import base64
import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from braggframe.llm import bytebpe, chat, common, html_text, lines, media, ngram_join, packing, pieces, quality, sharding, warc
from braggframe.llm.common import components
from braggframe.llm.queries import references, vocabulary

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, size long, shard int, h long, at int, first string, length long, token long, grp long, component_id long, kept boolean, near boolean, piece int, `offset` long, _text string, `a.b` string"


def random_text(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def hard(spark):
    rng = random.Random(7)
    base = random_text(rng, 80)
    words = base.split(" ")
    texts = [None, "", " \n\t ", "one", "one two three", base, base, base.upper().replace("É", "é"), " ".join([*words[:40], "other", *words[41:]]), " ".join([*words[:20], "x", *words[21:60], "y", *words[61:]]), "\n".join([base, base, "Line that is long enough to be compared.", "Line that is long enough to be compared!"])]
    texts += ["Line that is long enough to be compared.", "<|im_end|>odd ퟿ ▁ <|endoftext|> " + "\x00 　", random_text(rng, 30_000), "### " * 90, "z" * 5000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, base), (3, "one"), (3, "another text for the same id"), (None, "no id"), (None, "no id")]
    rows = [(i, t, None if i == 4 else "en", "s", None if t is None else len(t), 1, 2, 3, 4, 5, "f", 6, 7, 8, 9, True, False, 1, 2, "t", "dot") for i, t in rows]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def shingles(text, width=5):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = WORD.findall((text or "").translate(fold))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def linked(rows, percent=75):
    """Smallest doc_id of each doc_id's component, by holding every row against every other."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = defaultdict(list)
    for n, (_, s) in enumerate(sets):
        for x in s:
            by[x].append(n)
    common = Counter((a, b) for ns in by.values() for a in ns for b in ns if a < b)
    for (a, b), k in common.items():
        if 100 * k >= percent * (len(sets[a][1]) + len(sets[b][1]) - k):
            x, y = root(sets[a][0]), root(sets[b][0])
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}


def pairs_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


@pytest.mark.parametrize("table", ["hard", "docs"])
def test_ngram_join(table, request):
    df = request.getfixturevalue(table)
    rows = pairs_of(df, "doc_id", "text")
    got = pairs_of(ngram_join.ngram_groups(df), "doc_id", "n_shingles", "component_id")
    want = linked(rows)
    assert Counter(got) == Counter((i, len(shingles(t)), want.get(i)) for i, t in rows)


def test_ngram_join_opens_chunks_of_large_groups(spark, monkeypatch):
    """A family of many near copies, with chunks and query blocks of a few members."""
    monkeypatch.setattr(ngram_join, "CHUNK", 4)
    monkeypatch.setattr(ngram_join, "QUERIES", 4)
    rng = random.Random(1)
    words = random_text(rng, 70).split(" ")
    rows = []
    for i in range(90):
        w = list(words)
        for k in rng.sample(range(70), rng.randint(0, 3)):
            w[k] = f"w{i}x{k}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, random_text(rng, 40) + " " + " ".join(words[:30])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert dict(pairs_of(ngram_join.ngram_groups(df), "doc_id", "component_id")) == linked(rows)


def test_ngram_join_in_rounds(spark, monkeypatch):
    """Where its rows are beyond a broadcast, the texts still go to their places alone, round by round, and the links are the same."""
    rng = random.Random(2)
    rows = []
    for i in range(40):
        words = random_text(rng, 40).split(" ")
        rows += [(3 * i + k, " ".join(words[: 40 - k] + [f"w{i}x{k}"])) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    written, plans, stored_at = Counter(), [], common._stored_at

    def noted(path, rounds):
        name = path.rsplit("/", 1)[1][:-33]
        written[name] = max(written[name], len(rounds))
        plans.extend(f._jdf.queryExecution().executedPlan().toString() for f in rounds if name in ("ngram-matrix", "ngram-probed"))
        return stored_at(path, rounds)

    monkeypatch.setattr(common, "BROADCAST_BYTES", 1200)
    monkeypatch.setattr(common, "_stored_at", noted)
    assert dict(pairs_of(ngram_join.ngram_groups(df), "doc_id", "component_id")) == linked(rows)
    assert written["ngram-probed"] > 1 and not any("SortMergeJoin" in plan for plan in plans)


def test_stored_rounds_leave_no_shuffle_files(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 7)
    status = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses()
    before = status.size()
    got = common.stored_rounds([df.repartition("k"), df.repartition(3, "id")], "rounds")
    assert status.size() <= before and got.count() == 2000
    common.drop_stored(got)


def test_shingles_of_long_texts_and_words(monkeypatch):
    """Sliced or whole, with words of any length: as many shingles as the text has, and the same ones."""
    from braggframe.llm import shingles as made

    import pyarrow as pa

    rng = random.Random(12)
    text = " ".join("".join(rng.choice("abcÄX") for _ in range(rng.choice([1, 2, 3, 700]))) for _ in range(3000))
    whole = [len(shingles(text)), list(made.shingle_sets(pa.array([text])))[0].tolist()]
    assert len(whole[1]) == whole[0]
    monkeypatch.setattr(made, "SLICE_BYTES", 2000)
    got = list(made.shingle_sets(pa.array([text, None, "a b", text.upper().replace("ä", "Ä")])))
    assert got[0].tolist() == whole[1] == got[3].tolist() and len(got[1]) == 0 and len(got[2]) == 1


def test_counts_merge():
    counts = ngram_join._Counts()
    rng = random.Random(13)
    want = Counter()
    for _ in range(40):
        s = np.unique(np.array([rng.randrange(300) for _ in range(50)], np.uint64))
        counts.add(s)
        want.update(s.tolist())
        if rng.random() < 0.3:
            counts.merge()
    counts.merge()
    assert dict(zip(counts.tokens.tolist(), counts.counts.tolist(), strict=True)) == want


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(1000, x) for x in range(1001, 1200)] + [(5, 5)]
    parent: dict = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = dict(pairs_of(components(spark.createDataFrame(edges, "a long, b long")), "node", "component"))
    assert all(got.get(i, i) == root(i) for i in parent)


def brute_lines(rows, edits, floor=0):
    """Texts without their repeated lines, by DuckDB's edit distance over all pairs of different lines."""
    place = lambda i: (i is not None, i or 0)
    first = {}
    for i, t in rows:
        for j, s in enumerate((t or "").split("\n")):
            if WORD.search(s):
                first[s] = min(first.get(s, ((True, 1 << 60), 0)), (place(i), j))
    many = [(s, *first[s][0], first[s][1]) for s in first if len(s) >= floor and len(s) < 3000]
    # DuckDB counts bytes: other letters become control characters, one byte each.
    others = sorted({x for s, *_ in many for x in s if ord(x) > 126})
    assert len(others) < 30
    fold, back = {ord(x): chr(i + 1) for i, x in enumerate(others)}, {i + 1: x for i, x in enumerate(others)}
    many = [(s.translate(fold), *more) for s, *more in many]
    c = duckdb.connect()
    c.sql("create table l (s varchar, a boolean, b bigint, j int)")
    c.executemany("insert into l values (?, ?, ?, ?)", many or [("", True, 0, 0)])
    near = {r[0].translate(back) for r in c.sql(f"select y.s from l x join l y on (x.a, x.b, x.j) < (y.a, y.b, y.j) and abs(length(x.s) - length(y.s)) <= {edits} and levenshtein(x.s, y.s) <= {edits}").fetchall()}
    out = []
    for i, t in rows:
        kept = None if t is None else "\n".join(s for j, s in enumerate(t.split("\n")) if not WORD.search(s) or (first[s] == (place(i), j) and s not in near))
        out.append((i, kept))
    return Counter(out)


@pytest.mark.parametrize("edits", [1, 2])
@pytest.mark.parametrize("table", ["hard", "docs"])
def test_line_dedup(table, edits, request):
    df = request.getfixturevalue(table)
    got = lines.deduped_lines(df, edits)
    assert got.columns == [*df.columns, "n_lines", "n_dropped"]
    rows = pairs_of(df, "doc_id", "text")
    if table == "docs":
        rng = random.Random(3)
        edited = []
        for i, t in rows[:60]:
            s = list(t[:400])
            for _ in range(rng.randint(1, 3)):
                k = rng.randrange(len(s))
                s[k] = rng.choice(["", "q", s[k] + "j"])
            edited.append((100_000 + i, "".join(s)))
        rows += edited + [(200_000 + i, t[:400]) for i, t in rows[:60]]
        got = lines.deduped_lines(df.sparkSession.createDataFrame(rows, "doc_id long, text string"), edits)
    assert Counter(pairs_of(got, "doc_id", "text")) == brute_lines(rows, edits)


@pytest.mark.parametrize("edits, floor", [(0, 0), (1, 0), (2, 0), (2, 4), (3, 0)])
def test_short_lines(spark, edits, floor, monkeypatch):
    """Lines of 1 to 9 code points, on both sides of every length that is treated apart, and keys that meet in blocks."""
    monkeypatch.setattr(lines, "BLOCK", 5)
    rng = random.Random(edits)
    rows = [(i, "\n".join("".join(rng.choice("abcdefgé") for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 30]))) for _ in range(rng.randint(1, 3)))) for i in range(1, 120)]
    rows += [(500 + i, "same beginning of all lines, " + "".join(rng.choice("xyz") for _ in range(6))) for i in range(40)]
    got = lines.deduped_lines(spark.createDataFrame(rows, "doc_id long, text string"), edits, floor)
    assert Counter(pairs_of(got, "doc_id", "text")) == brute_lines(rows, edits, floor)


def test_lines_of_clashing_columns_and_long_texts(spark):
    names = ["n_dropped", "N_LINES", "_lost", "lost", "lost_id", "_lost_id"]
    df = spark.createDataFrame([(1, "a line of its own\na line of its own", *"uvwxyz")], ["doc_id", "text", *names])
    got = lines.deduped_lines(df)
    assert got.columns == ["doc_id", "text", *names[2:], "n_lines", "n_dropped"] and got.first() == (1, "a line of its own", *"wxyz", 2, 1)
    many = spark.createDataFrame([(1, "\n".join(f"line {i % 50_000}, as long as a line should be, {i % 50_000 * 7919}" for i in range(100_000)))], "doc_id long, text string")
    assert lines.deduped_lines(many, 0).select("n_lines", "n_dropped").first() == (100_000, 50_000)
    for edits in (-1, 15):
        with pytest.raises(ValueError):
            lines.deduped_lines(df, edits)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_automaton(spark, edits):
    rng = random.Random(edits)
    pairs = []
    for _ in range(300):
        a = [rng.choice("ab") for _ in range(rng.randint(0, 40))]
        b = list(a)
        for _ in range(rng.randint(0, edits + 2)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "b", "ab"])
        pairs.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in lines.with_near(df, "a", "b", edits).withColumn("d", F.levenshtein("a", "b")).collect():
        assert r.near == (r.d <= edits), r


@pytest.mark.parametrize("table", ["hard", "docs"])
def test_quality(table, request):
    df = request.getfixturevalue(table)
    got = quality.judged(df, ["doc_id", "text"])
    want = Counter()
    for i, t in pairs_of(df, "doc_id", "text"):
        w, seen, dup, cover = WORD.findall(t or ""), set(), 0, set()
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        for k in range(len(w) - 2):
            if c[tuple(w[k : k + 3])] > 1:
                cover |= {k, k + 1, k + 2}
        for s in (t or "").split("\n"):
            if WORD.search(s):
                dup += s in seen
                seen.add(s)
        want[i, t, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)] += 1
    assert Counter(pairs_of(got, "doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want
    assert got.where("base_failed and kept").count() == 0


def test_quality_verdicts(spark):
    """Labelled documents: hardly a good one is lost to the divergence rules, and most bad ones that pass the base rules are."""
    sf = SF.replace("0.001", "0.1")
    judged = quality.judged(spark.read.parquet(f"{sf}/documents.parquet"), ["doc_id"], references=references(spark, sf)).where("not base_failed")
    rates = dict(pairs_of(judged.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))), "quality", "avg(CAST(kept AS INT))"))
    assert rates[1] > 0.99 and rates[0] < 0.05


def test_verdicts_do_not_depend_on_other_documents(spark, docs):
    known = references(spark, SF)
    assert set(known) == {None, "de", "en", "es", "fr"}
    whole = dict(pairs_of(quality.judged(docs, ["doc_id"], references=known), "doc_id", "kept"))
    some = dict(pairs_of(quality.judged(docs.where("length(text) % 3 = 0"), ["doc_id"], references=known), "doc_id", "kept"))
    assert some and all(whole[i] == kept for i, kept in some.items())
    assert dict(pairs_of(quality.judged(docs, ["doc_id"], references={}), "doc_id", "kept")) == dict(pairs_of(quality.judged(docs, ["doc_id"], references={}).withColumn("kept", ~F.col("base_failed")), "doc_id", "kept"))


@pytest.mark.parametrize("kinds", [1, 3, 50])
def test_repeated_words_are_exact_where_hashes_collide(docs, hard, kinds):
    few = lambda *w: F.pmod(F.xxhash64(*w), F.lit(kinds))
    for df in (docs.limit(60), hard.where("length(text) < 20000")):
        a, b = (quality.counted(df.select("doc_id", "text"), "text", *more) for more in ((), (few,)))
        assert Counter(pairs_of(a, "doc_id", "text", "n_repeat_words")) == Counter(pairs_of(b, "doc_id", "text", "n_repeat_words"))


def plain_words(rng, n, listed):
    """Made-up words, a share of them listed ones."""
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(5, 9)))
    return " ".join(rng.choice(quality.COMMON["en"]) if rng.random() < listed else f"{word()}{rng.choice(['', '', '', '', ',', '.'])}" for _ in range(n))


@pytest.fixture(scope="module")
def salad(spark):
    """Texts with a usual share of listed words (1-100), and without any of 400 (1001-) and 60-190 words (2001-)."""
    rng = random.Random(12)
    rows = [(i, plain_words(rng, rng.randint(250, 900), 0.35)) for i in range(1, 101)]
    rows += [(1000 + i, plain_words(rng, 400, 0)) for i in range(1, 11)] + [(2000 + i, plain_words(rng, 50 + 14 * i, 0)) for i in range(1, 11)]
    return quality.judged(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).cache()


def test_quality_without_listed_words(salad):
    """No listed word is the largest distance of common words, not a pass."""
    bad = salad.where("doc_id between 1001 and 2000")
    assert bad.where("language is null and not base_failed and common_distance > 0.22").count() == 10 and bad.where("kept").count() == 0
    assert salad.where("doc_id <= 100 and kept").count() == 100


def test_quality_of_short_texts(spark, salad):
    """Common words decide from 50 words on; of the labelled documents hardly any bad one stays, short ones included."""
    bad = salad.where("doc_id > 2000 and not base_failed")
    assert bad.count() == 10 and bad.where("n_words < 200").count() == 10 and bad.where("kept").count() == 0
    sf = SF.replace("0.001", "0.1")
    judged = quality.judged(spark.read.parquet(f"{sf}/documents.parquet"), ["doc_id"], references=references(spark, sf)).where("not base_failed and n_words < 200")
    rates = dict(pairs_of(judged.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("r")), "quality", "r"))
    assert rates[1] > 0.99 and rates[0] < 0.05


@pytest.mark.parametrize("table", ["hard", "docs"])
def test_sharding(table, request):
    df = request.getfixturevalue(table)
    got = pairs_of(sharding.vector_shards(df, 6, ["doc_id", "text"]), "doc_id", "text", "size", "text_crc32", "shard", "slot")
    assert Counter(r[:4] for r in got) == Counter((i, t, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in pairs_of(df, "doc_id", "text"))
    slots = defaultdict(list)
    for r in got:
        slots[r[4]].append(r[5])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(6))
    if table == "docs":
        sizes = Counter()
        for r in got:
            sizes[r[4]] += r[2]
        assert max(sizes.values()) < 1.02 * sum(sizes.values()) / 6
        homes = defaultdict(set)
        for r in got:
            homes[r[1]].add(r[4])
        assert all(len(h) == 1 for h in homes.values())


def place_one_by_one(items, left):
    """The rule in plain Python: largest first, highest dot product with what is left, among shards with room."""
    total = [sum(x[k] for x in left) or 1.0 for k in range(3)]
    rest, out = [[v / t for v, t in zip(x, total, strict=True)] for x in left], {}
    slack = [sharding.SLACK * x[0] for x in rest]
    for i in sorted(range(len(items)), key=lambda i: ([-v for v in items[i]], i)):
        share = [v / t for v, t in zip(items[i], total, strict=True)]
        room = [k for k in range(len(rest)) if rest[k][0] + slack[k] >= share[0]]
        score = lambda k: sum(a * b for a, b in zip(rest[k], share, strict=True)) if room else rest[k][0]  # noqa: B023, E731
        best = max(room or range(len(rest)), key=lambda k: (round(score(k), 15), -k))
        out[i] = best
        rest[best] = [a - b for a, b in zip(rest[best], share, strict=True)]
    return [out[i] for i in range(len(items))]


def test_placing_follows_the_dot_product():
    rng = random.Random(15)
    for shards in (1, 3, 7):
        items = [[float(rng.randint(1, 4000)), float(rng.randint(0, 700)), float(rng.randint(1, 3))] for _ in range(200)]
        left = [[sum(x[k] for x in items) / shards for k in range(3)] for _ in range(shards)]
        assert sharding.place(np.array(items), np.array(left)).tolist() == place_one_by_one(items, left)


def test_shards_balance_bytes_tokens_and_rows(spark, docs, monkeypatch):
    """Jointly, with groups placed in one portion or in several, and equal texts together."""
    rows = docs.select("doc_id", "text").unionByName(docs.select((F.col("doc_id") + 1000).alias("doc_id"), F.upper("text").alias("text")))
    for portion in (20_000, 40):
        monkeypatch.setattr(sharding, "PORTION", portion)
        got = sharding.vector_shards(rows, 4, ["doc_id", "text"]).withColumn("words", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))
        loads = got.groupBy("shard").agg(F.sum("size").alias("s"), F.sum("words").alias("w"), F.count("*").alias("n")).toPandas()
        assert len(loads) == 4 and all(loads[c].max() < limit * loads[c].mean() for c, limit in (("s", 1.02), ("w", 1.1), ("n", 1.15)))
        assert got.groupBy("text").agg(F.count_distinct("shard").alias("k")).where("k > 1").count() == 0


def test_sharding_splits_a_hot_group(spark):
    df = spark.createDataFrame([(i, "the same text" if i % 3 else f"text {i} of its own") for i in range(3000)], "doc_id long, text string")
    sizes = pairs_of(sharding.vector_shards(df, 24, ["doc_id"]).groupBy("shard").agg(F.sum("size").alias("s")), "shard", "s")
    assert len(sizes) == 24 and max(s for _, s in sizes) < 1.05 * min(s for _, s in sizes)


def test_pieces_equal_the_library():
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    codec, library, rng = pieces.PieceCodec(path), sentencepiece.SentencePieceProcessor(model_file=path), random.Random(5)
    parts = [" ", "\n", "a", "b", "the", "ing", "é", "1", "23", "!", "\t", "日本", "<s>", "</s>", "<unk>", "\x1f", "  ", "...", "\xa0", "\r\n", "😀", "▁", "    ", "<0x41>", ";\r", "\x00", "ABAB", "xx"]
    texts = ["", " ", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 18))) for _ in range(3000)), *("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 60))) for _ in range(500))]
    for text, ids, (line, n, decoded) in zip(texts, library.encode(texts), codec.encode(texts), strict=True):
        assert line == " ".join(map(str, ids)) and n == len(ids) and decoded == library.decode(ids), text


def test_long_words_equal_the_library():
    """Words without an end: one round a rank, not one a merge."""
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    codec, library, rng = pieces.PieceCodec(path), sentencepiece.SentencePieceProcessor(model_file=path), random.Random(6)
    texts = [rng.choice(["a", "aa", "ab", "=", "the", "an"]) * rng.randint(1, 400) for _ in range(60)] + ["".join(rng.choice("etaoinsh") for _ in range(rng.randint(1, 900))) for _ in range(200)]
    texts.append(base64.b64encode(rng.randbytes(60_000)).decode())
    for text, ids, (line, _, decoded) in zip(texts, library.encode(texts), codec.encode(texts), strict=True):
        assert line == " ".join(map(str, ids)) and decoded == library.decode(ids), text[:50]
    assert codec.kept_chars <= pieces.KEPT_CHARS + pieces.KEPT_LONGEST and all(len(w) <= pieces.KEPT_LONGEST for w in codec.kept)


def test_piece_coding_of_a_table(hard, empty):
    out = pieces.piece_coded(hard, vocabulary("piece_bpe_32k.model"), keep=("doc_id", "text"))
    codec = pieces.PieceCodec(vocabulary("piece_bpe_32k.model"))
    for r in out.collect():
        assert codec.model.decoded(r.ids[:-1]) == r.decoded == (r.text or "").replace("▁", " ") and r.n_tokens == len(r.ids) and r.ids[-1] == 2
    assert out.count() == hard.count() and pieces.piece_coded(empty, vocabulary("piece_bpe_32k.model")).count() == 0


def test_byte_ids_equal_the_library():
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    mine, library, rng = bytebpe.ByteTokens(path), Tokenizer.from_file(path), random.Random(6)
    parts = [" ", "\n", "a", "b", "'s", "'ll", "é", "1", "23", "!", "\t", "　", "日本", "<|endoftext|>", "\x1f", "  ", "..", "\xa0", "\r\n", "😀", "'", "word.", "é,", "́.", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    for text, ids, e in zip(texts, mine.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids, text


@pytest.mark.parametrize("table", ["hard", "docs"])
def test_packing(table, request):
    from tokenizers import Tokenizer

    df, path = request.getfixturevalue(table), vocabulary("byte_bpe_50k.json")
    got = pairs_of(packing.best_fit(df, path, keep=("doc_id", "text")), "doc_id", "text", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    library = Tokenizer.from_file(path)
    want, total = Counter(), 0
    for i, t in pairs_of(df, "doc_id", "text"):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        total += len(ids)
        for p, (s, n) in enumerate(packing.pieces_of(len(ids), 1024)):
            want[i, t, p, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    assert Counter(r[:6] for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r[6]].append((r[7], r[4]))
    for spans in sequences.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(sequences) <= -(-total // 1024) * 1.05 + 1


@pytest.mark.parametrize("rows", [200_000, 60])
@pytest.mark.parametrize("kind", ["any", "short", "alike"])
def test_rounds_pack_like_best_fit_decreasing(spark, monkeypatch, rows, kind):
    """In one range and in many: as many sequences as one loop over all pieces makes."""
    monkeypatch.setattr(packing, "RANGE_ROWS", rows)
    rng = random.Random(8)
    sizes = {"any": [rng.randint(1, 100) for _ in range(400)], "short": [rng.randint(1, 9) for _ in range(500)] + [70] * 20, "alike": [34] * 150 + [33] * 150}[kind]
    gaps: list[int] = []
    for s in sorted(sizes, reverse=True):
        fit = min((g for g in gaps if g >= s), default=None)
        if fit is None:
            gaps.append(100 - s)
        else:
            gaps[gaps.index(fit)] -= s
    got = packing.placed(spark, spark.createDataFrame(list(enumerate(sizes)), "id long, length long").cache(), 100).collect()
    assert sorted(r.id for r in got) == list(range(len(sizes)))
    loads = Counter()
    for r in got:
        loads[r.seq] += sizes[r.id]
    assert max(loads.values()) <= 100 and len(loads) <= len(gaps) + (rows == 60)


def test_left_gaps_serve_later_ranges_last_first():
    # Two gaps are left in range 0 and one in range 1; range 1 took none, range 2 wants four.
    assert packing.served([(0, 0, 2), (1, 0, 1), (2, 4, 0)]) == [(2, 0, 1, 1, 0), (2, 1, 2, 0, 1)]
    assert packing.served([(0, 3, 0), (1, 1, 5)]) == []


def said(rows):
    text = hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in rows).encode()).hexdigest()
    learnt = "".join(t or "" for r, t in rows if r == "assistant")
    return len(rows), text, len(learnt), hashlib.sha256(learnt.encode()).hexdigest()


def test_chat(spark):
    rng = random.Random(9)
    control = ["<|im_end|>", "<|im_start|>assistant\n", "<\\|im_end|>", "<|endoftext|>", "<", "|", "\\", "\n", "", None, "plain words"]
    turns = []
    for conv in range(60):
        for turn in range(rng.randint(1, 6)):
            role = ["system", "user", "assistant", "odd\\nrole\n<|x"][min(turn, 3) if conv % 5 else rng.randrange(4)]
            text = "shared start" if turn == 0 and conv % 2 else rng.choice(control) if rng.random() < 0.5 else "".join(str(rng.choice(control)) for _ in range(5))
            turns.append((conv, turn, role, text, "extra"))
    turns += [(101, 0, None, None, "e"), (None, 0, "user", "no id", "e"), (102, 0, "user", "long " * 60_000, "e")]
    turns += [(200 + i, t, "user" if t % 2 == 0 else "assistant", f"copy {t}", "e") for i in range(30) for t in range(4)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, path string").repartition(5)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.formatted_chats(df, vocabulary("byte_bpe_50k.json")).collect()}
    by = defaultdict(list)
    for conv, turn, role, text, _ in turns:
        by[conv].append((turn, role or "", text or ""))
    assert got == {c: said([x[1:] for x in sorted(rows)]) for c, rows in by.items()}
    assert chat.formatted_chats(df.where("false"), vocabulary("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("tokens", [1 << 16, 60])
def test_packs_share_turns_once(spark, monkeypatch, tokens):
    """Whether all fits one pack or packs are small: a shared turn is emitted once, and later packs refer to it."""
    monkeypatch.setattr(chat, "PACK_TOKENS", tokens)
    rows = [(c, t, "user" if t % 2 else "assistant", x) for c in range(20) for t, x in enumerate(["common opening words", f"second turn {c // 5}", f"own turn {c}", "and its end"])]
    paths = chat.conversation_paths(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    frame = chat.chat_packs(paths.coalesce(1), vocabulary("byte_bpe_50k.json")).coalesce(1).cache()
    packs = frame.collect()
    assert (len(packs) > 6) == (tokens == 60)
    parts = len({p.part for p in packs})
    assert 1 + 4 + 20 + 20 <= sum(len(p.nodes) for p in packs) <= 1 + 4 + 20 + 20 + 2 * (parts - 1)
    for p in packs:
        for n in p.nodes:
            before = sum(c.last - c.first for c in n.context)
            assert p.positions[n.first : n.last] == list(range(before, before + n.last - n.first))
            assert all((c.pack, c.last) <= (p.pack, n.first) for c in n.context)
            assert all(not (a.pack == b.pack and a.last == b.first) for a, b in zip(n.context, n.context[1:], strict=False))
    read = {r.path: r.turns_sha256 for r in chat.read_packs(frame, vocabulary("byte_bpe_50k.json")).collect()}
    by = defaultdict(list)
    for c, _, role, text in rows:
        by[c].append((role, text))
    assert {c: read[path] for c, path in pairs_of(paths, "conv_id", "path")} == {c: said(x)[1] for c, x in by.items()}


def test_a_long_conversation_has_one_interval(spark):
    rows = [(1, t, "user", f"turn {t}") for t in range(10_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    packs = chat.chat_packs(chat.conversation_paths(df), vocabulary("byte_bpe_50k.json")).select(F.explode("nodes").alias("n")).agg(F.count("*").alias("n"), F.max(F.size("n.context")).alias("c")).first()
    assert packs.n == 10_000 and packs.c == 1
    assert chat.formatted_chats(df, vocabulary("byte_bpe_50k.json")).first().n_turns == 10_000


PAGES = "page_id long, url string, html string, path string, host string, text string"


def page_rows():
    body = "<html><body><nav>menu</nav><div class='post-1'><p>One &amp; two<br>three</p><p>More text here, a &lt; b.</p></div><footer>end</footer></body></html>"
    rows = [(i, f"http://Host{i % 2}.example.com/x?{i}", body.replace("One", f"One {i}")) for i in range(8)]
    return rows + [(20, "http://host0.example.com/", body), (21, None, body), (22, "http://host1.example.com:80/a", ""), (23, "http://x.org", None), (24, "no url", "just text"), (None, "http://x.org", "<p>é</p>"), (20, "http://host0.example.com/", body), (25, "http://y.org/\r\nX: y", "<b>")]


def test_extraction(spark):
    df = spark.createDataFrame([(*r, "p", "h", "t") for r in page_rows()], PAGES)
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html_text.extracted_pages(df).collect()}
    assert got[3, "http://Host1.example.com/x?3"] == ("One 3 & two three More text here, a < b.", 40)
    assert got[22, "http://host1.example.com:80/a"] == ("", 0) == got[23, "http://x.org"] and got[24, "no url"][0] == "just text" and got[None, "http://x.org"][0] == "é"
    assert html_text.extracted_pages(df).count() == df.count() and html_text.extracted_pages(df.where("false")).count() == 0
    paths = dict(pairs_of(html_text.host_paths(df), "host", "path"))
    assert paths["host0.example.com"] == html_text.path_of(["html", "body", "div.post-#"])


WHOLE = {
    "wrapper": ("<article><h1>Title</h1><div class=content><p>{t}</p><p>{t}</p></div></article>", "Title {t} {t}"),
    "lead": ("<article><h1>Title</h1><div class=lead><p>Lead words.</p></div><div class=content><p>{t}</p></div><div class=more><p>Last words.</p></div></article>", "Title Lead words. {t} Last words."),
    "main": ("<main><div class=intro>Lead words.</div><article><h2>Title</h2><section class=a><p>{t}</p></section><section class=b><p>Last.</p></section></article></main>", "Lead words. Title {t} Last."),
    "no article": ("<div class=page><div class=links><a href=/a>One link</a> <a href=/b>another link</a></div><div class=body><h1>Title</h1><div class=text><p>{t}</p></div></div></div>", "Title {t}"),
    "links beside": ("<main><ul><li><a href=/a>One link</a></li><li><a href=/b>another link</a></li></ul><article><h1>Title</h1><div class=x><p>{t}</p></div></article></main>", "Title {t}"),
}


@pytest.mark.parametrize("name", WHOLE)
def test_whole_article(spark, name):
    """Headings, lead blocks and further sections beside the densest container stay, with the host's path and without it."""
    page, want = WHOLE[name]
    rows = [(i, f"http://whole.example.com/{i}", f"<html><body><nav>menu</nav>{page.format(t=f'Body words of page {i}, many of them. ' * 10 + 'End.')}<footer>end</footer></body></html>") for i in range(3)]
    got = {r.page_id: r.text for r in html_text.extracted_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: want.format(t=f"Body words of page {i}, many of them. " * 10 + "End.") for i in range(3)}
    assert html_text.main_text(rows[0][2], None) == got[0]


HTML = {
    "<p>a<p>b": "a b",
    "<article><h1>T</h1><p>a <b>b</b>c</article><div id=comments><p>no, no, no</div>": "T a bc",
    "<div class='sidebar'>x</div><main><p>y</main>": "y",
    "<body><div class=content>text <script>var a = '</p>';</script>more<form>f</form></div><aside>z</aside>": "text more",
    "<article><ul><li>a<li>b</ul><div class='ad'>buy</div><table><tr><td>c<td>d</table></article>": "a b c d",
    "<article>a&nbsp;b &eacute; <!-- <p>no</p> --> c < d</article>": "a b é c < d",
    "<article><p hidden>no</p><p style='display:none'>no</p><p>yes</p>": "yes",
    "<div class='page-header'>X</div><div class='content has-sidebar'><div class='post-comments'>no</div><p>body words</p><div id='main-nav'>n</div></div>": "body words",
    "<div class='cookie-notice'>ok?</div><div><p>main words</p></div>": "main words",
}


@pytest.mark.parametrize("page", HTML)
def test_main_text(page):
    paths = html_text.best_paths(page)
    assert html_text.main_text(page, paths[0][0] if paths else None) == HTML[page]


@pytest.mark.parametrize("page", ["<" + "a" * 500_000, "<a href=\"x>t" * 40_000 + "'", "<a href='x title=\"y>t" * 30_000, "<div>x" * 100_000, "<b>x" * 100_000, "<div>" * 40_000 + "</p>" * 40_000 + "</x>" * 40_000, "<table><tr><td>" * 30_000, "<ul><li>t" * 40_000, "<" * 500_000])
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    html_text.best_paths(page)
    html_text.main_text(page, None)
    assert time.process_time() - began < 10


def test_generated_articles(spark):
    """Pages made from a known article among furniture that differs by host: an extractor that knows the template agrees."""
    rng = random.Random(14)
    sentence = lambda: " ".join("".join(rng.choice("etaoinsrhd") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(5, 14))).capitalize() + "."
    rows, want = [], {}
    for i in range(120):
        host, blocks = i % 6, [sentence() for _ in range(rng.randint(3, 9))]
        menu = "<ul>" + "".join(f"<li><a href='/{k}'>{sentence()[:12]}</a></li>" for k in range(5)) + "</ul>"
        body = "".join(f"<h2>{b}</h2>" if k == 2 else f"<p>{b[:9]}<em>{b[9:]}</em></p>" for k, b in enumerate(blocks))
        article = [f"<article>{body}</article>", f"<div class='post-{i}'>{body}</div>", f"<main><section>{body}</section></main>", f"<div id=c><div class='entry text'>{body}</div></div>"][host % 4]
        rows.append((i, f"http://h{host}.org/{i}", f"<html><head><title>{sentence()}</title><style>p {{}}</style></head><body><nav>{menu}</nav><div class='sidebar'>{menu}</div>{article}<div class='comments'><p>{sentence()}</p></div><footer><p>{sentence()}</p></footer><script>var x = '<p>no</p>';</script></body></html>"))
        want[i] = " ".join(blocks)
    got = dict(pairs_of(html_text.extracted_pages(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id", "text"))
    assert got == want


def test_warc(spark):
    df = spark.createDataFrame([(*r, "p", "h", "t") for r in page_rows()], PAGES).repartition(3)
    first: dict = {}
    for i, _, h in sorted(page_rows(), key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(h or "", i)
    want = Counter()
    for i, _, h in page_rows():
        data = (h or "").encode()
        origin = first[h or ""]
        want[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if origin == i else "revisit", None if origin == i else origin] += 1
    got = warc.page_captures(df)
    assert Counter(pairs_of(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == want
    assert got.where("n_records <> 3 or not coalesce(digest_ok, true)").count() == 0
    assert warc.page_captures(df.where("false")).count() == 0


def test_warc_payloads_come_back(spark, tmp_path):
    df = spark.createDataFrame(page_rows(), "page_id long, url string, html string")
    warc.write_archives(df, f"file://{tmp_path}/w")
    c = warc.captures(warc.read_records(spark, f"file://{tmp_path}/w", payloads=True))
    assert {r.p for r in c.where("response.type = 'response'").select(F.col("response.payload").alias("p")).collect()} == {h or "" for _, _, h in page_rows()}
    assert c.where("request.type <> 'request' or metadata.fields['page-id'] is null").count() == 0


@pytest.mark.parametrize("compressed", [False, True])
def test_warc_rolls_by_bytes(spark, tmp_path, monkeypatch, compressed):
    """Files close by bytes whatever a page's size; a page of several files' size is one record. Members of gzip files stand alone."""
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    monkeypatch.setattr(warc, "READ_BYTES", 3_000)
    rng = random.Random(16)
    pages = [(i, f"http://h.org/{i}", "".join(rng.choice("abcdefghé\r\n") for _ in range(rng.choice([0, 10, 3000, 90_000 if i == 7 else 500])))) for i in range(60)]
    pages += [(100 + i, None, "\r\n\r\nWARC/1.1\r\n" * 3) for i in range(3)]
    path = f"file://{tmp_path}/w"
    assert warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), path, compressed) == 3 * len(pages)
    files = sorted((tmp_path / "w").glob("part-*.warc*"))
    assert len(files) > 3 and not list((tmp_path / "w").glob("_held*"))
    got = warc.captures(warc.read_records(spark, path, payloads=True))
    assert got.count() == len(pages) and got.where("n_records <> 3 or not coalesce(response.digest_ok, true)").count() == 0
    assert {r.p for r in got.where("response.type = 'response'").select(F.col("response.payload").alias("p")).collect()} == {p[2] for p in pages}


def test_warc_of_a_large_page(spark):
    page = "<p>" + "x" * (50 << 20)
    got = warc.page_captures(spark.createDataFrame([(1, "http://h.org", page), (2, "http://h.org", "<p>y")], "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.payload_bytes, r.digest_ok) for r in got) == [(1, len(page), True), (2, 4, True)]


def test_media(hard, empty):
    want = Counter()
    for i, t in pairs_of(hard, "doc_id", "text"):
        data = (t or "").encode()
        payload = media.padded(data)
        image = media.to_image(payload)
        assert media.from_image(image) == payload and len(payload) % 576 == 0
        want[i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest(), media.features(payload)] += 1
    got = media.media_columns(hard)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert media.media_columns(empty).count() == 0


def test_media_against_plain_decoding(spark, docs, tmp_path):
    """The archives read with zipfile, the images by the PNG rules alone, the features in plain Python."""
    import zipfile

    folder = tmp_path / "m"
    media.write_archives(docs.limit(40), f"file://{folder}")
    want = {}
    for path in folder.glob("*.zip"):
        with zipfile.ZipFile(path) as z:
            for name in z.namelist():
                image, at, data = z.read(name), 8, b""
                while at < len(image):
                    n = int.from_bytes(image[at : at + 4], "big")
                    data += image[at + 8 : at + 8 + n] if image[at + 4 : at + 8] == b"IDAT" else b""
                    assert int.from_bytes(image[at + 8 + n : at + 12 + n], "big") == zlib.crc32(image[at + 4 : at + 8 + n])
                    at += 12 + n
                width = int.from_bytes(image[16:20], "big")
                raw = zlib.decompress(data)
                samples = b"".join(raw[i + 1 : i + 1 + width] for i in range(0, len(raw), width + 1))
                mean = sum(samples) / len(samples)
                deviation = (sum((x - mean) ** 2 for x in samples) / len(samples)) ** 0.5
                levels = [sum(1 for x in samples if x >> 4 == k) * 1000 // len(samples) for k in range(16)]
                want[int(name.removesuffix(".png"))] = (samples, f"mean={mean:.4f};std={deviation:.4f};levels=" + ",".join(map(str, levels)))
    got = media.read_archives(spark, f"file://{folder}").mapInArrow(media._measured, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    texts = dict(pairs_of(docs, "doc_id", "text"))
    rows = got.collect()
    assert len(rows) == len(want) == 40
    for r in rows:
        samples, feature = want[r.doc_id]
        data = texts[r.doc_id].encode()
        assert samples == data + b"\xff" * (len(samples) - len(data)) and len(samples) % 576 == 0
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) == (len(data), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), feature)


def test_media_ranges_cover_every_member_once(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/m"
    assert media.write_archives(docs, folder) == docs.count()
    for size in ("1000", "50000", "99999999"):
        got = media.read_archives(spark, folder, rangeBytes=size, batchBytes="20000")
        assert got.count() == docs.count() == got.select("archive", "at").distinct().count()


def test_media_retries_a_member(monkeypatch, spark, docs, tmp_path):
    folder = f"file://{tmp_path}/m"
    media.write_archives(docs.limit(20).coalesce(1), folder)
    failed, plain = set(), media.read_member

    def flaky(fs, path, offset, size):
        if offset not in failed:
            failed.add(offset)
            raise OSError("lost")
        return plain(fs, path, offset, size)

    monkeypatch.setattr(media, "read_member", flaky)
    reader = media._Reader({"path": folder})
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 20 and len(failed) == 20


@pytest.mark.parametrize("run", [ngram_join.ngram_groups, lines.deduped_lines, lambda d: quality.judged(d, ["doc_id"]), lambda d: sharding.vector_shards(d, 24, ["doc_id"]), lambda d: packing.best_fit(d, vocabulary("byte_bpe_50k.json"))])
def test_empty_tables(empty, run):
    assert run(empty).count() == 0


def test_pipeline(spark, docs):
    import corpus_pipeline

    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF).cache()
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        if name == "quality_rules":
            ids = {r.doc_id for r in quality.judged(kept, ["doc_id"], references=references(spark, SF)).where("kept").collect()}
            assert {r.doc_id for r in out.collect()} == ids
        if name == "line_dedup":
            want = {i: t for i, t in brute_lines(pairs_of(kept, "doc_id", "text"), lines.EDITS) if WORD.search(t)}
            assert dict(pairs_of(out, "doc_id", "text")) == want and out.where("n_chars <> length(text)").count() == 0
        if name == "ngram_join":
            roots = linked(pairs_of(kept, "doc_id", "text"))
            assert {r.doc_id for r in out.collect()} == set(roots.values())
        kept = out
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.collect()}
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_pipeline_decides_by_row(spark, docs):
    """Rows with a repeated or null doc_id are kept or not by their own text; of exact repeats one stays."""
    import corpus_pipeline

    kept, seen = [], set()
    judged = quality.judged(docs, ["doc_id", "text"], references=references(spark, SF)).where("kept")
    for (t,) in sorted(pairs_of(judged, "text")):
        own = t.split("\n")
        if 600 < len(t) < 6000 and len(set(own)) == len(own) and seen.isdisjoint(own) and seen.isdisjoint(shingles(t)):
            seen.update(own, shingles(t))
            kept.append(t)
    good, odd, free, *others = kept[:13]
    short = ["too short a text to be kept.", "another text that is too short."]
    texts = [(1, good), (1, good), (1, short[0]), (2, odd), (None, free), (None, free), (None, short[1]), (2, good)]
    rows = [(i, t, "en", "s", len(t)) for i, t in texts] + [(100 + i, t, "en", "s", len(t)) for i, t in enumerate(others)]
    rows = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages, some = dict(corpus_pipeline.STAGES), lambda df: Counter((i, t) for i, t in pairs_of(df, "doc_id", "text") if i is None or i < 100)
    assert some(stages["quality_rules"](spark, rows, SF)) == Counter([(1, good), (1, good), (2, odd), (None, free), (None, free), (2, good)])
    once = {(1, good): 1, (2, odd): 1, (None, free): 1}
    long = rows.where("n_chars > 500")
    assert some(stages["line_dedup"](spark, long, SF)) == once and some(stages["ngram_join"](spark, long, SF)) == once
    # The same line at the same place of two texts of one doc_id: the first keeps it, and no other line goes with it.
    line, a, b = "A line of its own that both of these texts begin with.", "First text goes on in its own words.", "Another second line of the other."
    pair = spark.createDataFrame([(5, f"{line}\n{a}", "en", "s", 1), (5, f"{line}\n{b}", "en", "s", 1)], rows.schema)
    assert sorted(len(t.split("\n")) for _, t in pairs_of(stages["line_dedup"](spark, pair, SF), "doc_id", "text")) == [1, 2]
