"""Sets of word shingles as sorted arrays of 64-bit hashes, made with numpy from the UTF-8 bytes of a batch."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from .common import BLANKS, mixed, text_bytes

#: Bytes of text that are hashed together, and bytes from which a word is hashed by a digest.
SLICE_BYTES, LONG_WORD = 1 << 18, 512

_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32
_blank = np.zeros(256, bool)
_blank[[ord(c) for c in BLANKS]] = True
_byte = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, SLICE_BYTES), _powers(_BACK, SLICE_BYTES)


def _digest(pieces: Iterable[np.ndarray]) -> int:
    """The hash of a long word. A polynomial of so many places can be made to collide, a digest can't."""
    h = hashlib.blake2b(digest_size=8)
    for piece in pieces:
        h.update(_fold[piece].tobytes())
    return int.from_bytes(h.digest(), "little")


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of lower-cased (A-Z) texts of at most SLICE_BYTES together, and the first word of each text."""
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    blank = _blank[data]
    start, end = ~blank, ~blank
    start[1:] &= blank[:-1] | first[1:n]
    end[:-1] &= blank[1:] | first[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_byte[_fold[data]] * _UP[:n], out=total[1:])
    hashes = mixed((total[e] - total[s]) * _DOWN[:n][s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(e - s >= LONG_WORD).tolist():
        hashes[i] = _digest([data[s[i] : e[i]]])
    return hashes, np.searchsorted(s, offsets)


def _long_text_words(data: np.ndarray) -> Iterator[np.ndarray]:
    """Word hashes of one text, slice by slice; slices end after a blank, and a word longer than a slice is read in pieces."""
    at, n = 0, len(data)
    while at < n:
        stop = min(n, at + SLICE_BYTES)
        if stop < n:
            blanks = np.flatnonzero(_blank[data[at:stop]])
            if not len(blanks):
                pieces, end = [], at
                while end < n:
                    piece = data[end : min(n, end + SLICE_BYTES)]
                    blanks = np.flatnonzero(_blank[piece])
                    pieces.append(piece[: blanks[0]] if len(blanks) else piece)
                    end += len(pieces[-1])
                    if len(blanks):
                        break
                yield np.array([_digest(pieces)], np.uint64)
                at = end
                continue
            stop = at + int(blanks[-1]) + 1
        yield words_of(data[at:stop], np.array([0, stop - at]))[0]
        at = stop


def _rolled(words: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        out += words[k : k + len(out)] * np.uint64(pow(0x2545F4914F6CDD1D, k + 1, 1 << 64))
    return mixed(out)


def _short(words: np.ndarray) -> np.ndarray:
    """The shingle of a text with fewer words than a shingle has."""
    if not len(words):
        return np.zeros(0, np.uint64)
    one = sum(int(x) * pow(0xDA942042E4DD58B5, k + 1, 1 << 64) for k, x in enumerate(words)) + len(words)
    return mixed(np.array([one % (1 << 64)], np.uint64))


def _long_text_shingles(data: np.ndarray, width: int) -> np.ndarray:
    """The set of a long text: the distinct shingles of its slices, each with the last words of the one before, merged as they grow."""
    have, fresh, size, tail = np.zeros(0, np.uint64), [], 0, np.zeros(0, np.uint64)
    for words in _long_text_words(data):
        words = np.concatenate([tail, words])
        if len(words) >= width:
            fresh.append(np.unique(_rolled(words, width)))
            size += len(fresh[-1])
            words = words[len(words) - width + 1 :]
        tail = words
        if size > len(have) + SLICE_BYTES:
            have, fresh, size = np.unique(np.concatenate([have, *fresh])), [], 0
    have = np.unique(np.concatenate([have, *fresh])) if fresh else have
    return have if len(have) else _short(tail)


def shingle_sets(col: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For each text its distinct shingles of width words, ascending; with fewer words, the sequence as one; without, none.

    Texts are hashed in slices of SLICE_BYTES; a longer text in several, so that beside a text only its set grows with it.
    """
    data, offsets = text_bytes(col)
    i, n = 0, len(offsets) - 1
    while i < n:
        if offsets[i + 1] - offsets[i] > SLICE_BYTES:
            yield _long_text_shingles(data[offsets[i] : offsets[i + 1]], width)
            i += 1
            continue
        j = int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1
        words, at = words_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        rolled = _rolled(words, width)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield np.unique(rolled[a : b - width + 1]) if b - a >= width else _short(words[a:b])
        i = j


def bands_of(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys of a one-permutation min-hash: the first shingle from each of bands * rows bounds, the first of all where none follows."""
    bounds = (np.arange(bands * rows, dtype=np.uint64) * np.uint64((1 << 64) // (bands * rows))).astype(np.uint64)
    picks = shingles[np.searchsorted(shingles, bounds) % len(shingles)].reshape(bands, rows)
    out = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(rows):
        out = mixed(out + picks[:, k])
    return out.view(np.int64)
