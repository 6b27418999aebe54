"""N-gram Jaccard join over a token-group matrix.

Every text is the set of its distinct word shingles (64-bit hashes). Texts with equal sets are one node. The join

1. makes one pass over all texts for set sizes, set digests, min-hash bands and the tokens that recur within chunks;
2. puts similar sets into groups: each node is held exactly against the smallest node of each of its min-hash buckets,
   and the components of the links found are the groups (a group that misses a member costs time, never a link);
3. orders tokens, the recurring ones last, so that a passage that many documents share lies outside almost every
   prefix. Two sets of the asked similarity share a token among the first n - ceil(t * n) + 1 of each, so the prefixes
   alone find every (node, group) pair to look at;
4. stores the token-group matrix: a row a group with its token union, ascending, and the members of each of its tokens (a
   group of one is its text, which spells its union in less space);
5. bounds each query's overlap with a group by its tokens in the group's union. Only where that reaches t * n is the group
   opened: the members of the tokens found give the exact overlap with each member (a union of one member is that itself);
6. takes the components of all links.

A group is stored in chunks of at most CHUNK members and about CHUNK_TOKENS tokens, and probed by at most QUERIES queries at
a time, so no task holds a whole group. The order of tokens changes only the work: any order gives every link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, collected, column, components, dealt_rounds, drop_stored, small, stored, stored_rounds
from .shingles import bands_of, shingle_sets

BANDS, ROWS, BANDS_SHARED = 12, 4, 2
#: Nodes of a bucket that are put in order together.
SALTED = 4096
CHUNK, CHUNK_TOKENS, QUERIES = 1024, 2 << 20, 4096
#: Tokens that are put in order together, and different tokens of a chunk of documents among which recurring ones are counted.
SORTED, COUNTED = 1 << 18, 1 << 20
#: At most so many recurring tokens are put last in the order, the most frequent ones.
LATE, LATE_FROM = 1 << 18, 8
_SET = "doc_id long, n long, sig binary, bands array<long>, tokens array<long>, counts array<long>"


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


class _Counts:
    """How many sets hold each token, kept as two sorted arrays that grow by merging."""

    def __init__(self) -> None:
        self.tokens, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, s: np.ndarray) -> None:
        self.held.append(s)
        self.size += len(s)
        if self.size >= SORTED:
            self.merge()

    def merge(self) -> None:
        fresh, n = np.unique(np.concatenate([*self.held, np.zeros(0, np.uint64)]), return_counts=True)
        self.held, self.size = [], 0
        at = np.searchsorted(self.tokens, fresh)
        known = np.zeros(len(fresh), bool)
        inside = at < len(self.tokens)
        known[inside] = self.tokens[at[inside]] == fresh[inside]
        self.counts[at[known]] += n[known]
        self.tokens = np.insert(self.tokens, at[~known], fresh[~known])
        self.counts = np.insert(self.counts, at[~known], n[~known])


def _measured(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        names = ["doc_id", "n", "sig", "bands", "tokens", "counts"]
        seen, counted = set(), _Counts()

        def recurring() -> pa.RecordBatch:
            counted.merge()
            keep = counted.counts > 1
            return pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.binary()), _lists([none]), _lists([counted.tokens[keep]]), _lists([counted.counts[keep]])], names)

        for batch in batches:
            n, sigs, bands = [], [], []
            for s in shingle_sets(column(batch, "text"), width):
                n.append(len(s))
                sigs.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                bands.append(bands_of(s, BANDS, ROWS) if len(s) else none)
                if len(s) and sigs[-1] not in seen:
                    seen.add(sigs[-1])
                    counted.add(s)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(sigs, pa.binary()), _lists(bands), _lists([none] * len(n)), _lists([none] * len(n))], names)
            if len(counted.tokens) >= COUNTED:
                yield recurring()
                seen, counted = set(), _Counts()
        yield recurring()

    return run


def _prefixes(width: int, percent: int, late: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """late: recurring tokens, ascending, with their place in the order."""
    keys, places = late[0], late[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, rare = [], []
            for s in shingle_sets(column(batch, "text"), width):
                p, early = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0, len(s)
                if p and len(keys):
                    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                    hot = keys[at] == s
                    if hot.any():
                        early = int((~hot).sum())
                        s = np.concatenate([s[~hot], s[hot][np.argsort(places[at[hot]])]])
                out.append(s[:p])
                rare.append(min(early, p))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id").cast(pa.int64()), _lists(out), pa.array(rare, pa.int32())], ["doc_id", "prefix", "rare"])

    return run


_MATRIX = "grp long, chunk int, blocks int, union array<long>, docs array<long>, sizes array<long>, counts array<int>, members array<int>"
_PROBED = "doc_id long, grp long, chunk int, block int, n long, other long, steps array<int>"


def _ints(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _unions(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Members come sorted by group and chunk; a row of the matrix for each: the union, and for each of its tokens how many and which members."""

    def row(key: tuple[int, int, int], docs: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        union, counts = np.unique(flat, return_counts=True)
        members = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)[order]
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([key[2]], pa.int32()), _lists([union]), _lists([np.array(docs, np.int64)]), _lists([sizes]), _ints([counts]), _ints([members])], ["grp", "chunk", "blocks", "union", "docs", "sizes", "counts", "members"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, docs, sets = None, [], []
        for batch in batches:
            for *k, doc, s in zip(*(column(batch, c).to_pylist() for c in ("grp", "chunk", "blocks", "doc_id")), shingle_sets(column(batch, "text"), width), strict=True):
                if tuple(k) != key:
                    if docs:
                        yield row(key, docs, sets)
                    key, docs, sets = tuple(k), [], []
                docs.append(doc)
                sets.append(s)
        if docs:
            yield row(key, docs, sets)

    return run


def _array(col: pa.Array, i: int, kind: type) -> np.ndarray:
    return np.asarray(col[i].values, kind)


def _probing(width: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A union comes before its queries. Queries whose tokens in the union reach percent of their own, and the places of these tokens.

    Places are given as steps from the one before, small numbers. Of a union of one member the overlap is exact: if the two are
    similar, other is that member, and there is nothing to open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, union, only = None, None, None
        none = np.zeros(0, np.int32)
        for batch in batches:
            out = []
            unions = column(batch, "union")
            keys = (column(batch, c).to_pylist() for c in ("grp", "chunk", "block", "doc_id", "only"))
            for i, (*k, doc, one, s) in enumerate(zip(*keys, shingle_sets(column(batch, "text"), width), strict=True)):
                if doc is None:
                    key, only = k, one
                    union = s if one is not None else _array(unions, i, np.int64).view(np.uint64)
                elif k == key:
                    at = np.searchsorted(union, s)
                    at = at[(at < len(union)) & (union[np.minimum(at, len(union) - 1)] == s)]
                    if only is None and 100 * len(at) >= percent * len(s):
                        out.append((doc, *k, len(s), None, np.diff(at, prepend=0)))
                    elif only not in (None, doc) and 100 * len(at) >= percent * (len(union) + len(s) - len(at)):
                        out.append((doc, *k, len(s), only, none))
            arrays = [pa.array([r[j] for r in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*arrays, _ints([r[6] for r in out])], ["doc_id", "grp", "chunk", "block", "n", "other", "steps"])

    return run


def _opening(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row of the matrix comes before the queries that open it: a link of each query to the smallest similar member, if any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, docs, sizes, ends, members = None, None, None, None, None
        for batch in batches:
            links = []
            lists = {c: column(batch, c) for c in ("docs", "sizes", "counts", "members", "steps")}
            for i, (*k, doc, n) in enumerate(zip(*(column(batch, c).to_pylist() for c in ("grp", "chunk", "block", "doc_id", "n")), strict=True)):
                if doc is None:
                    key, docs, sizes = k, _array(lists["docs"], i, np.int64), _array(lists["sizes"], i, np.int64)
                    ends, members = np.cumsum(_array(lists["counts"], i, np.int64)), _array(lists["members"], i, np.int32)
                elif k == key:
                    at = np.cumsum(_array(lists["steps"], i, np.int64))
                    b = ends[at]
                    a = np.where(at > 0, ends[at - 1], 0)
                    take = np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]), b - a) + np.arange((b - a).sum())
                    both = np.bincount(members[take], minlength=len(docs))
                    good = (100 * both >= percent * (sizes + n - both)) & (docs != doc)
                    if good.any():
                        links.append((doc, int(docs[good].min())))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

    return run


def _open_groups(texts: DataFrame, queries: DataFrame, members: DataFrame, total: int, width: int, percent: int) -> DataFrame:
    """Links (a, b) between the queries (doc_id, grp) and the members (doc_id, grp, n) of the groups; one a chunk at most for each query. total: how many documents there are."""
    weight = members.groupBy("grp").agg(F.count("*").alias("members"), F.sum("n").alias("tokens"))
    chunks = F.greatest(F.ceil(F.col("members") / CHUNK), F.ceil(F.col("tokens") / CHUNK_TOKENS))
    n = queries.groupBy("grp").agg(F.count("*").alias("queries")).join(weight, "grp")
    n = n.select("grp", F.ceil(F.col("queries") / QUERIES).cast("int").alias("blocks"), F.least(chunks, F.col("members")).cast("int").alias("chunks"), (F.col("members") == 1).alias("alone"))
    m = members.join(n, "grp").select("doc_id", "grp", F.pmod(F.xxhash64("doc_id"), "chunks").cast("int").alias("chunk"), "blocks", F.when(F.col("alone"), 1).otherwise(0).alias("role"))
    q = queries.join(n, "grp").select("doc_id", "grp", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.pmod(F.xxhash64("doc_id", F.lit(7)), "blocks").cast("int").alias("blocks"), F.lit(2).alias("role"))
    rows = stored(m.unionByName(q), "ngram-rows", 8 * total)
    # Texts travel rather than sets: they are smaller, and a set is made again in little time. They go to their places in rounds
    # whose rows are broadcast, so no text is shuffled to meet its rows, and only a round's texts are on the disks.
    place, null = ["grp", "chunk", "block"], lambda t: F.lit(None).cast(t)
    each_block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    held = rows.where("role = 0").select("doc_id", "grp", "chunk", "blocks")
    lone = rows.where("role = 1").select("grp", "chunk", each_block, null("long").alias("doc_id"), F.col("doc_id").alias("only"))
    asking = lone.unionByName(rows.where("role = 2").select("grp", "chunk", F.col("blocks").alias("block"), "doc_id", null("long").alias("only")))
    asking = asking.withColumn("_text_of", F.coalesce("doc_id", "only"))
    named = texts.select(F.col("doc_id").alias("_text_of"), "text")

    def matrix_of(part: Column) -> DataFrame:
        some = texts.join(F.broadcast(held.where(part)), "doc_id").select("doc_id", "grp", "chunk", "blocks", "text")
        return some.repartition("grp", "chunk").sortWithinPartitions("grp", "chunk").mapInArrow(_unions(width), _MATRIX)

    def probed_of(part: Column) -> DataFrame:
        unions = matrix.select("grp", "chunk", each_block, null("long").alias("doc_id"), null("long").alias("only"), null("string").alias("text"), "union").where(part)
        some = named.join(F.broadcast(asking.where(part)), "_text_of").select(*place, "doc_id", "only", "text", null("array<long>").alias("union"))
        return unions.unionByName(some).repartition(*place).sortWithinPartitions(*place, F.asc_nulls_first("doc_id")).mapInArrow(_probing(width, percent), _PROBED)

    matrix = stored_rounds(map(matrix_of, dealt_rounds(held, 40, ["grp", "chunk"])), "ngram-matrix")
    probed = stored_rounds(map(probed_of, dealt_rounds(asking, 40, place)), "ngram-probed")
    lists, reached = ["docs", "sizes", "counts", "members"], probed.where("other is null")
    asked = stored(reached.select(*place).distinct(), "ngram-asked", total)
    opened = matrix.drop("union").join(small(asked, 32), ["grp", "chunk"]).select(*place, null("long").alias("doc_id"), null("long").alias("n"), null("array<int>").alias("steps"), *lists)
    kinds = dict(matrix.dtypes)
    finding = reached.select(*place, "doc_id", "n", "steps", *(null(kinds[c]).alias(c) for c in lists))
    links = opened.unionByName(finding).repartition(*place).sortWithinPartitions(*place, F.asc_nulls_first("doc_id")).mapInArrow(_opening(percent), "a long, b long")
    links = links.unionByName(probed.where("other is not null").select(F.col("doc_id").alias("a"), F.col("other").alias("b")))
    out = stored(links.distinct(), "ngram-links")
    drop_stored(rows, matrix, probed, asked)
    collected(out.sparkSession)
    return out


def _recurring(measured: DataFrame) -> np.ndarray:
    """The LATE most frequent recurring tokens and their places in the order: a table of fixed size, not the tokens of the corpus."""
    pairs = measured.where("n is null").select(F.explode(F.arrays_zip("tokens", "counts")).alias("x")).select("x.tokens", "x.counts")
    top = pairs.groupBy("tokens").agg(F.sum("counts").alias("w")).where(F.col("w") >= LATE_FROM).orderBy(F.desc("w"), "tokens").limit(LATE).toPandas()
    keys = top["tokens"].to_numpy(np.int64).view(np.uint64)
    by_key = np.argsort(keys)
    return np.stack([keys[by_key], (len(keys) - 1 - by_key).astype(np.uint64)])


def ngram_groups(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the smallest doc_id reached by links of Jaccard >= percent / 100), n_links.

    n_links counts the links that the join had to find for the document's node, a spanning part of all links.
    Null or wordless text: n_shingles 0 and its own component. Rows that share a doc_id are one node and stay separate
    rows. A null doc_id links with nothing and has a null component. A very long text is hashed slice by slice; its set, 8
    bytes a shingle, is held in one task. Equal sets tie and are one node, of the smallest doc_id. Other columns of docs are
    ignored, whatever their names; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    measured = stored(texts.mapInArrow(_measured(width), _SET), "ngram-measured")
    rows = measured.where("n is not null")
    total = rows.count()  # bounds the tables of one row a node
    nodes = rows.where("sig is not null and doc_id is not null").groupBy("sig").agg(F.min_by(F.struct("doc_id", "n", "bands"), "doc_id").alias("x")).select("sig", "x.*")
    nodes = stored(nodes, "ngram-nodes", total)
    own = stored(rows.where("sig is not null and doc_id is not null").select("doc_id", "sig").distinct().join(nodes.select("sig", F.col("doc_id").alias("node")), "sig").select("doc_id", "node").distinct(), "ngram-own", total)
    buckets = nodes.select("doc_id", "n", F.posexplode("bands").alias("band", "key"))
    firsts = buckets.groupBy("band", "key").agg(F.min_by(F.struct("doc_id", "n"), "doc_id").alias("first"), F.count("*").alias("c")).where("c > 1")
    crowded = buckets.join(firsts.select("band", "key", F.col("first.doc_id").alias("grp"), F.col("first.n").alias("g_n"), F.ceil(F.col("c") / SALTED).cast("int").alias("salts")), ["band", "key"])
    # Two bands shared with a bucket's first make a similarity worth the check likely. In a family around the threshold
    # the first is often too far, so each node is also held against the one before it. What both miss the prefixes find.
    stars = crowded.where("doc_id <> grp").groupBy("doc_id", "grp", "g_n").agg(F.count("*").alias("c")).where(F.col("c") >= BANDS_SHARED).drop("c")
    before = F.lag(F.struct("doc_id", "n")).over(W.partitionBy("band", "key", F.pmod(F.xxhash64("doc_id"), F.col("salts"))).orderBy("doc_id"))
    chains = crowded.withColumn("_b", before).where("_b is not null and doc_id <> _b.doc_id").select("doc_id", F.col("_b.doc_id").alias("grp"), F.col("_b.n").alias("g_n"))
    stars = stored(stars.union(chains).distinct(), "ngram-stars", 8 * total)
    near = _open_groups(texts, stars.select("doc_id", "grp"), stars.select(F.col("grp").alias("doc_id"), "grp", F.col("g_n").alias("n")).distinct(), total, width, percent)
    groups = components(near)

    late = _recurring(measured)
    labelled = nodes.select("doc_id", "n").distinct().join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("grp", F.coalesce("component", "doc_id")).drop("component")
    sizes = labelled.groupBy("grp").agg(F.count("*").alias("members"))
    labelled = stored(labelled.join(sizes, "grp").select("doc_id", "n", "grp", "members"), "ngram-labelled", total)
    prefixes = texts.mapInArrow(_prefixes(width, percent, late), "doc_id long, prefix array<long>, rare int")
    entries = prefixes.join(small(labelled.select("doc_id").distinct(), 16), "doc_id", "left_semi").select("doc_id", "rare", F.posexplode("prefix").alias("pos", "token"))
    # Tokens that recur go on in any case and are dealt by document, so no frequent token is gathered here; the others are
    # brought together to see whether two documents have one.
    entries = entries.withColumn("_salt", F.when(F.col("pos") >= F.col("rare"), F.col("doc_id")))
    over = W.partitionBy("token", "_salt")
    met = entries.withColumns({"_lo": F.min("doc_id").over(over), "_hi": F.max("doc_id").over(over)}).where("_salt is not null or _lo < _hi").select("token", "doc_id", "pos")
    met = stored(met, "ngram-met")
    entries = met.join(small(labelled, 48), "doc_id")
    common = entries.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo < hi").select("token")
    shared = stored(entries.join(common, "token"), "ngram-shared")
    # Of a pair the smaller set (or either, if equal) has a common token in a shorter prefix: n - ceil(2t / (1 + t) * n) + 1.
    n = F.col("n")
    marked = shared.withColumn("early", F.col("pos") < n - F.ceil(n * (2 * percent) / (100 + percent) - 1e-6) + 1)
    held = marked.groupBy("token", F.col("grp").alias("g"), F.col("members").alias("g_members")).agg(F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.max("early").alias("g_early"))
    either = F.when(n > F.col("n_max"), F.col("g_early")).when(n < F.col("n_min"), F.col("early")).otherwise(F.col("early") | F.col("g_early"))
    meet = marked.join(held, "token").where((F.struct("members", "grp") < F.struct("g_members", "g")) & (F.col("n") * percent <= F.col("n_max") * 100) & (F.col("n_min") * percent <= F.col("n") * 100) & either)
    pairs = meet.groupBy("doc_id", "n", F.col("g").alias("grp"), F.col("g_members").alias("of")).agg(F.count("*").alias("c"), F.max("pos").alias("last"), F.min("n_min").alias("n_min"), F.max("n_max").alias("n_max"))
    # Of one member, all tokens up to the last shared one are compared; the overlap is at most theirs and the rest.
    reach = F.col("c") + F.col("n") - F.col("last") - 1
    need = F.ceil((F.col("n") + F.col("n_min")) * percent / (100 + percent) - 1e-6)
    queries = stored(pairs.where((F.col("of") > 1) | (reach >= need)).select("doc_id", "grp"), "ngram-queries", 8 * total)
    opened = labelled.select("doc_id", "grp", "n").join(queries.select("grp").distinct(), "grp")
    more = _open_groups(texts, queries, opened, total, width, percent)

    links = stored(near.unionByName(more).unionByName(own.where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))), "ngram-all")
    linked = links.select(F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n_links"))
    found = components(links).select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))
    drop_stored(nodes, own, stars, near, met, shared, queries, more, labelled)
    joined = rows.select("doc_id", F.col("n").alias("n_shingles")).join(found, "doc_id", "left").join(linked, "doc_id", "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
