"""Vectorised words of many texts at once: lower-cased UTF-8 bytes, word runs and 64-bit word hashes.

A word is a maximal run of ASCII letters, digits, `_` and non-ASCII bytes, after Unicode lower-casing.
Null texts are empty. All hashes are pure functions of the bytes, so they agree on every executor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.Generator(np.random.PCG64(20240611))
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MULT = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123)]] = True
_WORD[128:] = True
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _powers
    if _powers.size < n:
        p = np.full(max(n, 4096), _BASE, np.uint64)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers


def joined(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, a line feed after each, and where each text starts (n + 1 values)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    arr = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        arr = pc.utf8_lower(arr)
    end = pa.scalar("\n", pa.large_string())
    arr = pc.binary_join_element_wise(arr, pa.scalar("", pa.large_string()), end)
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    off = np.frombuffer(off, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def run_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of b[start:end] for each run."""
    if not start.size:
        return np.zeros(0, np.uint64)
    size = end - start
    first = np.cumsum(size) - size
    k = np.arange(int(size.sum())) - np.repeat(first, size)
    at = k + np.repeat(start, size)
    h = np.add.reduceat(BYTE[b[at]] * powers(int(size.max()))[k], first)
    return mix(h ^ (size.astype(np.uint64) * MULT[63]))


class Words:
    """doc: index of the text, hash: of the word, start and end: bytes, n: words per text, first: its first word."""

    def __init__(self, texts: pa.Array, lower: bool = True):
        self.bytes, self.offset = joined(texts, lower)
        self.docs = len(self.offset) - 1
        edge = np.diff(_WORD[self.bytes].view(np.int8), prepend=np.int8(0))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.doc = np.searchsorted(self.offset, self.start, side="right") - 1
        self.hash = run_hashes(self.bytes, self.start, self.end)
        self.n = np.bincount(self.doc, minlength=self.docs) if self.docs else np.zeros(0, np.int64)
        self.first = np.cumsum(self.n) - self.n


def shingles(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) of every run of `size` words; a text of fewer words but one at least is one shingle."""
    if not w.hash.size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    rest = w.n[w.doc] - (np.arange(w.hash.size) - w.first[w.doc])
    padded = np.concatenate([w.hash, np.zeros(size, np.uint64)])
    h = np.zeros(w.hash.size, np.uint64)
    for i in range(size):
        h += np.where(i < rest, padded[i : i + w.hash.size] * MULT[i], np.uint64(0))
    keep = (rest >= size) | (rest == w.n[w.doc])
    return w.doc[keep], mix(h[keep] ^ np.minimum(rest[keep], size).astype(np.uint64))


def multisets(doc: np.ndarray, h: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, 48-bit hash, count) of the distinct hashes of each text, sorted. At most 65,536 texts at once."""
    assert docs <= 1 << 16
    key = np.sort((doc.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)))
    if not key.size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(at, key.size))
    key = key[at]
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1), count
