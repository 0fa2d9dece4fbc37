"""Word n-gram sets as sorted arrays of 64-bit hashes, computed a batch at a time."""

from __future__ import annotations

import numpy as np
import xxhash

#: Bytes of words stay, all others, those of longer UTF-8 sequences included, part words.
_WORDS = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(31))) * _M2
    h = (h ^ (h >> np.uint64(29))) * _M3
    return h ^ (h >> np.uint64(32))


class WordHashes(dict):
    """Word to hash; forgets all when it has held ``limit`` words, so that a task's memory stays bounded."""

    limit = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def gram_set(text: str | None, hashes: WordHashes, width: int) -> np.ndarray:
    """The distinct ``width``-word grams of ``text``, hashed and sorted; empty for null or short texts."""
    words = text.lower().encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else ()
    if len(words) < width:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(h) - width + 1
    g = h[:n] * _M1
    for i in range(1, width):
        g = (g ^ (g >> np.uint64(27))) * _M2 + h[i : i + n] * _M1
    return distinct(mix(g))


def distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct values; a plain sort is faster here than np.unique."""
    a.sort()
    keep = np.empty(len(a), bool)
    keep[:1] = True
    np.not_equal(a[1:], a[:-1], out=keep[1:])
    return a[keep]


def overlaps(xs: list[bytes], ys: list[bytes], dtype: str) -> np.ndarray:
    """Sizes of the intersections of two lists of sets, each a string of distinct values."""
    size = np.dtype(dtype).itemsize
    both = [np.frombuffer(b"".join(s), dtype) for s in (xs, ys)]
    pair = [np.repeat(np.arange(len(s)), [len(b) // size for b in s]) for s in (xs, ys)]
    value, pair = np.concatenate(both), np.concatenate(pair)
    order = np.lexsort((value, pair)) if size > 2 else np.argsort(pair * 65536 + value)
    value, pair = value[order], pair[order]
    twice = (value[1:] == value[:-1]) & (pair[1:] == pair[:-1])
    return np.bincount(pair[1:][twice], minlength=len(xs))


def set_print(grams: np.ndarray) -> int:
    """A signed 64-bit fingerprint of a set; equal sets have equal prints."""
    v = xxhash.xxh3_64_intdigest(grams.tobytes())
    return v - (1 << 64) if v >= 1 << 63 else v
