"""SentencePiece BPE encoding and decoding with numpy, by rounds of merges over flat symbol arrays.

A model file is read directly: pieces, scores and kinds, and the normaliser's flags. Texts fall into words at each
space (the mark U+2581) that follows another character, and at characters of no piece; no piece crosses either place,
so a word's ids do not depend on its neighbours. The words of a batch that are new stand in one flat array of symbols.
Each round takes for every word its best pair, merges all its places that do not overlap, from the left, in all words at
once, looks up the scores of the pairs that are new, and compacts the array, until no word has a pair left. The library's
queue merges one place at a time: where a merge makes a pair as good as the round's own or better, that pair is next, so a word's
round ends there. Characters that no piece covers become byte pieces. Words are kept, within a bound, with their ids and
their decoded text.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, column, texts_of

MARK = "▁"
#: Characters of the words that are kept, and of the longest such word; others are encoded anew.
KEPT_CHARS, KEPT_LONGEST = 4 << 20, 64
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
NONE = np.iinfo(np.int64).max


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message; fixed-width values as bytes."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[i : i + n]
            i += n


class PieceModel:
    """A BPE model with byte fallback and no text normalisation; other models are refused."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces, self.scores, self.kinds = [], [], []
        model_type, prefix, collapse, rules, fallback = 1, True, True, "identity", False
        for number, value in _fields(data):
            if number == 1:
                p = dict(_fields(value))
                self.pieces.append(p.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                self.kinds.append(p.get(3, NORMAL))
            elif number == 2:
                t = dict(_fields(value))
                model_type, fallback = t.get(3, 1), bool(t.get(35, 0))
            elif number == 3:
                t = dict(_fields(value))
                rules, prefix, collapse = t.get(1, b"").decode(), bool(t.get(3, 1)), bool(t.get(4, 1))
                if t.get(2):
                    rules = "a compiled map"
        if model_type != 2 or rules not in ("identity", "") or collapse or not fallback or USER in self.kinds:
            raise ValueError("only BPE models with byte fallback, no normalisation and no user-defined pieces")
        self.prefix = prefix
        self.end_id = next(i for i, p in enumerate(self.pieces) if p == "</s>" and self.kinds[i] == CONTROL)
        usable = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] in (NORMAL, UNUSED)}
        self.byte_ids = [i for i, k in enumerate(self.kinds) if k == BYTE]
        if any(MARK in p.lstrip(MARK) for p in usable):
            raise ValueError("a piece holds a space after another character")
        chars = sorted({c for p in usable for c in p})
        self.symbols: dict[str, int] = {c: i for i, c in enumerate(chars)}
        strings = list(chars)
        for p in sorted(usable, key=len):
            if p not in self.symbols:
                self.symbols[p] = len(strings)
                strings.append(p)
        self.width = len(strings) + 1
        self.unknown = len(strings)
        self.piece_of = np.array([usable.get(s, -1) for s in strings], np.int64)
        self.strings = strings
        keys, ranks, made = [], [], []
        order = sorted(usable, key=lambda p: -self.scores[usable[p]])
        place, last, rank = {}, None, -1
        for p in order:
            if self.scores[usable[p]] != last:
                last, rank = self.scores[usable[p]], rank + 1
            place[p] = rank
        for p in usable:
            for cut in range(1, len(p)):
                a, b = self.symbols.get(p[:cut]), self.symbols.get(p[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.width + b)
                    ranks.append(place[p])
                    made.append(self.symbols[p])
        by_key = np.argsort(np.array(keys, np.int64))
        self.keys, self.ranks, self.made = (np.array(x, np.int64)[by_key] for x in (keys, ranks, made))
        outside = "".join(re.escape(c) for c in map(chr, range(33)) if c not in self.symbols)
        self.apart = [c for c in map(chr, range(33)) if c not in self.symbols and c != " "]
        self.words = re.compile(f"{MARK}*[^{MARK}{outside}]+|{MARK}+|[{outside}]" if outside else f"{MARK}*[^{MARK}]+|{MARK}+")

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        text = text.replace(" ", MARK)
        return self.words.findall(MARK + text if self.prefix else text)

    def _paired(self, left: np.ndarray, right: np.ndarray, together: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE for no piece, or where the two are of different words) and symbol of the pairs."""
        pair = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where((self.keys[at] == pair) & together, self.ranks[at], NONE), self.made[at]

    def merged(self, words: list[str]) -> list[np.ndarray]:
        """Symbols of each word after its merges."""
        get, unknown = self.symbols.get, self.unknown
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.fromiter((get(c, unknown) for w in words for c in w), np.int64, int(sizes.sum()))
        word = np.repeat(np.arange(len(words)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, made = self._paired(flat, np.append(flat[1:], 0), np.append(word[1:] == word[:-1], False)) if len(flat) else (flat, flat)
        while len(flat) > 1:
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, first)
            lengths = np.diff(np.append(first, len(flat)))
            least = np.repeat(best, lengths)
            hit = np.flatnonzero((rank == least) & (rank < NONE))
            keep = least < NONE  # words without a pair are done
            done.append((word[~keep], flat[~keep]))
            if not len(hit):
                return self._split(words, done)
            # Of places that overlap the first, the third and so on.
            count = np.arange(len(hit))
            begins = np.maximum.accumulate(np.where(np.append(True, np.diff(hit) != 1), count, 0))
            hit = hit[(count - begins) % 2 == 0]
            new, of = made[hit], word[hit]
            # Pairs of the new symbol when its place is merged: those to its left are, those to its right are not yet.
            touching = np.append(False, np.diff(hit) == 2)
            left = np.where(touching, np.append(0, new[:-1]), flat[hit - 1])
            after = np.minimum(hit + 2, len(flat) - 1)
            a, _ = self._paired(left, new, (hit > 0) & (word[hit - 1] == of))
            b, _ = self._paired(new, flat[after], (hit + 2 < len(flat)) & (word[after] == of))
            stops = np.cumsum(np.minimum(a, b) <= least[hit])
            earlier = np.append(0, stops[:-1])  # places that end their round, before each place
            leads = np.maximum.accumulate(np.where(np.append(True, of[1:] != of[:-1]), np.arange(len(hit)), 0))
            hit, new = (x[earlier == earlier[leads]] for x in (hit, new))
            flat[hit] = new
            keep[hit + 1] = False
            place = np.cumsum(keep) - 1
            flat, word, rank, made, hit = flat[keep], word[keep], rank[keep], made[keep], place[hit]
            for at in (hit, hit[hit > 0] - 1):
                after = np.minimum(at + 1, len(flat) - 1)
                rank[at], made[at] = self._paired(flat[at], flat[after], (after > at) & (word[after] == word[at]))
        done.append((word, flat))
        return self._split(words, done)

    @staticmethod
    def _split(words: list[str], done: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        of, flat = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(of, kind="stable")
        return np.split(flat[order], np.searchsorted(of[order], np.arange(1, len(words) + 1))[:-1])

    def encoded(self, words: list[str]) -> list[list[int]]:
        """Ids of each word."""
        out = []
        for w, symbols in zip(words, self.merged(words), strict=True):
            ids, at = [], 0
            for s in symbols.tolist():
                n = len(self.strings[s]) if s != self.unknown else 1
                if s != self.unknown and self.piece_of[s] >= 0:
                    ids.append(int(self.piece_of[s]))
                else:
                    ids += [self.byte_ids[b] for b in w[at : at + n].encode()]
                at += n
            out.append(ids)
        return out

    def decoded(self, ids: list[int]) -> str:
        """Text of ids: marks become spaces, runs of byte pieces UTF-8, control pieces nothing; without the first space."""
        out, held, first = [], bytearray(), True
        for i in [*ids, None]:
            if i is not None and self.kinds[i] == BYTE:
                held.append(int(self.pieces[i][3:5], 16))
                first = False
                continue
            if held:
                out.append(bytes(held).decode(errors="replace"))
                held = bytearray()
            if i is not None and self.kinds[i] in (NORMAL, UNUSED):
                p = self.pieces[i]
                out.append((p[1:] if first and self.prefix and p[0] == MARK else p).replace(MARK, " "))
                first = False
        return "".join(out)


class PieceCodec:
    """Encodes and decodes texts through a bounded memory of words."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.kept: dict[str, tuple[str, int, str]] = {}
        self.kept_chars = 0

    def _entries(self, words: list[str]) -> list[tuple[str, int, str]]:
        m, out = self.model, []
        for ids in m.encoded(words):
            text = m.decoded([ids[0], *ids[1:]]) if not m.prefix or m.pieces[ids[0]][:1] != MARK else " " + m.decoded(ids)
            out.append((" ".join(map(str, ids)), len(ids), text))
        return out

    def encode(self, texts: list[str], slice_chars: int = 1 << 20) -> Iterator[tuple[str, int, str]]:
        """For each text: its ids in decimal joined by spaces, how many, and the text decoded from them."""
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= slice_chars):
                size += len(texts[j])
                j += 1
            yield from self._slice(texts[i:j])
            i = j

    def _slice(self, texts: list[str]) -> Iterator[tuple[str, int, str]]:
        rows, new = [], {}
        for t in texts:
            words = self.model.split(t)
            got = list(map(self.kept.get, words))
            missing = [i for i, x in enumerate(got) if x is None] if None in got else ()
            new.update((words[i], None) for i in missing)
            rows.append((words, got, missing))
        fresh = dict(zip(new, self._entries(list(new)), strict=True)) if new else {}
        for words, got, missing in rows:
            for i in missing:
                got[i] = fresh[words[i]]
            if not got:
                yield "", 0, ""
                continue
            ids, counts, parts = zip(*got, strict=True)
            text = "".join(parts)
            yield " ".join(ids), sum(counts), text[1:] if self.model.prefix and words[0][:1] == MARK else text
        for w, entry in fresh.items():
            if self.kept_chars >= KEPT_CHARS:
                break
            if len(w) <= KEPT_LONGEST:
                self.kept[w] = entry
                self.kept_chars += len(w)


@lru_cache(1)
def piece_codec(path: str) -> PieceCodec:
    """The memory of this worker, kept from task to task."""
    return PieceCodec(path)


def _coded(path: str, full: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = piece_codec(path)
        end = codec.model.end_id
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            n, ids, texts = [], [], []
            for line, many, text in codec.encode(texts_of(batch)):
                line = f"{line} {end}" if many else str(end)
                n.append(many + 1)
                ids.append(list(map(int, line.split(" "))) if full else sha(line))
                texts.append(text if full else sha(text))
            keys = [c for c in batch.schema.names if c != "text"]
            arrays = [pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32()) if full else pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in keys), *arrays], [*keys, "n_tokens", "ids", "decoded"])

    return run


def piece_coded(docs: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",), full: bool = True) -> DataFrame:
    """keep columns, n_tokens, ids (the end id last) and decoded, the text that the ids give; without full, SHA-256 digests of the two.

    A null or empty text is the end id alone and decodes to nothing. Rows that repeat stay, and are coded alike. A very long
    text is coded in one task, one without spaces as one word, in a round for each different rank of its merges or a little
    more. Other columns are dropped, whatever their names. An empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)
    names = [f"_keep{i}" for i in range(len(keep))]
    texts = docs.select(*(F.col(f"`{k}`").alias(n) for k, n in zip(keep, names, strict=True)), F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name != "text")
    out = texts.mapInArrow(_coded(model, full), f"{schema}, n_tokens long, ids {'array<int>' if full else 'string'}, decoded string")
    return out.select(*(F.col(n).alias(k) for k, n in zip(keep, names, strict=True)), "n_tokens", "ids", "decoded")
