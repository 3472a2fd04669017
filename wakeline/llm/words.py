"""Vectorised words of UTF-8 text: spans and 64-bit hashes without a Python loop over words.

Both word rules of this package separate at ASCII bytes only, so they can be applied to UTF-8 bytes directly:
ALNUM splits at every ASCII byte that is not a letter or digit, NONSPACE at ASCII white space.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from ._common import CHUNK_BYTES

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_tables: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, on uint64."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random value per byte, powers of an odd base, and their inverses modulo 2**64."""
    global _tables
    if _tables is None:
        byte = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        power = np.full(_BLOCK + 1, _BASE, np.uint64)
        inverse = np.full(_BLOCK + 1, pow(_BASE, -1, 1 << 64), np.uint64)
        power[0] = inverse[0] = 1
        _tables = byte, np.multiply.accumulate(power), np.multiply.accumulate(inverse)
    return _tables


class Chunk(NamedTuple):
    """Consecutive rows: lower-cased bytes, where each row starts, and its words."""

    first: int
    rows: int
    data: np.ndarray
    row_bytes: np.ndarray  # rows + 1 byte offsets
    starts: np.ndarray
    ends: np.ndarray
    row_words: np.ndarray  # rows + 1 word offsets

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def chunks(texts: pa.Array, is_word: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Rows in chunks of about `most` bytes; a longer row is a chunk of its own."""
    if len(texts) == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        own = LOWER[data[offsets[lo] : offsets[hi]]]
        row_bytes = offsets[lo : hi + 1] - offsets[lo]
        starts, ends = spans(own, row_bytes, is_word)
        yield Chunk(lo, hi - lo, own, row_bytes, starts, ends, np.searchsorted(starts, row_bytes))
        lo = hi


def spans(data: np.ndarray, row_bytes: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; a word never crosses a row."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = is_word[data]
    before = np.empty(n + 1, bool)
    before[0], before[1:] = False, inside
    after = np.empty(n + 1, bool)
    after[-1], after[:-1] = False, inside
    edge = row_bytes[(row_bytes > 0) & (row_bytes < n)]
    starts = after[:-1] & ~before[:-1]
    starts[edge] = inside[edge]
    ends = before[1:] & ~after[1:]
    ends[edge - 1] = inside[edge - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, the same wherever the span stands."""
    byte, power, inverse = _power_tables()
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = int(np.searchsorted(ends, base + _BLOCK, "right"))
        if j <= i:  # one span beyond the tables: fold its blocks
            h, own = 0, data[base : ends[i]]
            for k in range(0, len(own), _BLOCK):
                part = own[k : k + _BLOCK]
                h = (h * 31 + int((byte[part] * power[: len(part)]).sum(dtype=np.uint64))) % (1 << 64)
            out[i] = h
            i += 1
            continue
        own = data[base : ends[j - 1]]
        prefix = np.empty(len(own) + 1, np.uint64)
        prefix[0] = 0
        np.cumsum(byte[own] * power[: len(own)], out=prefix[1:])
        at = starts[i:j] - base
        out[i:j] = (prefix[ends[i:j] - base] - prefix[at]) * inverse[at]
        i = j
    return mix(out)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words' hashes (order matters); len(words) - k + 1 of them."""
    n = max(0, len(words) - k + 1)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h *= np.uint64(_BASE)
        h += words[j : j + n]
    return mix(h)
