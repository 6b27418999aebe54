"""Byte-level BPE ids of whole texts, through a bounded memory of chunks between single spaces.

The pre-tokeniser never joins across a single space between two other characters, nor across a single line feed
between two, so a text's ids are those of its chunks put together. A chunk is encoded once, with the ranks of the tokenizers
file, and then kept. Texts with other runs of white space, or with the vocabulary's special string, go to the
library whole.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import tiktoken

#: Characters of the chunks that are kept, and of the longest such chunk; others are encoded anew.
KEPT_CHARS, KEPT_LONGEST = 2 << 20, 64
_ODD = ("  ", "\n\n", " \n", "\n ", *"\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0     　", *map(chr, range(0x2000, 0x200B)))
BLANK = (" ", "\n")
MARKS = ".,;:!?"
# Fixed value: the pattern that this kind of vocabulary splits text by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteTokens:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.odd = (*_ODD, *self.special)
        self.kept: dict[str, bytes] = {}
        self.kept_chars = 0
        self.words = self._own()
        self.marks = {m: array("I", self.words.encode_ordinary(m)).tobytes() for m in MARKS}

    def _own(self) -> tiktoken.Encoding:
        """The same vocabulary in the library that is quicker on single words; ids rank the merges of such a vocabulary."""
        spelt = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in spelt} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in spelt)}
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in self.library.get_vocab(with_added_tokens=False).items() if piece not in self.special}
        return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of chunks. A mark after a letter is always a token of its own, so the word before it may be known."""
        get, encode, out, fresh = self.kept.get, self.words._core_bpe.encode_ordinary, [], {}
        for w in words:
            mark = b""
            if w[-1] in MARKS and w[-2:-1].isalpha():
                mark, w = self.marks[w[-1]], w[:-1]
            ids = get(w) or fresh.get(w)
            if ids is None:
                ids = fresh[w] = array("I", encode(w)).tobytes()
            out.append(ids + mark)
        return out

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str], slice_chars: int = 1 << 18) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= slice_chars):
                size += len(texts[j])
                j += 1
            yield from self._slice(texts[i:j])
            i = j

    def _slice(self, texts: list[str]) -> list[bytes]:
        get, lists, new, whole = self.kept.get, [], {}, []
        for t in texts:
            if any(x in t for x in self.odd) or t[:1] in BLANK or t[-1:] in BLANK:
                whole.append(t)
                lists.append(None)
                continue
            # A line feed is a chunk of its own, and a chunk after a space carries it.
            chunks: list[str] = []
            for line in t.split("\n") if t else ():
                if chunks:
                    chunks.append("\n")
                chunks += line.replace(" ", "\x1f ").split("\x1f")
            ids = list(map(get, chunks))
            if None in ids:
                missing = [i for i, x in enumerate(ids) if x is None]
                new.update((chunks[i], None) for i in missing)
                lists.append((ids, missing, chunks))
            else:
                lists.append((ids, (), ()))
        fresh = dict(zip(new, self._words(list(new)), strict=True)) if new else {}
        for x in lists:
            if x is not None:
                for i in x[1]:
                    x[0][i] = fresh[x[2][i]]
        for chunk, ids in fresh.items():  # the frequent chunks come early
            if self.kept_chars >= KEPT_CHARS:
                break
            if len(chunk) <= KEPT_LONGEST:
                self.kept[chunk] = ids
                self.kept_chars += len(chunk)
        odd = iter(self._ids(whole)) if whole else iter(())
        return [next(odd) if x is None else b"".join(x[0]) for x in lists]


@lru_cache(1)
def byte_tokens(path: str) -> ByteTokens:
    """The memory of this worker, kept from task to task."""
    return ByteTokens(path)
