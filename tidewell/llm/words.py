"""Vectorised word hashing over Arrow string buffers.

A word is a maximal run of bytes outside [\\x20\\x09-\\x0D]; UTF-8 continuation
bytes never fall into that class, so byte scanning equals code-point scanning.
Every function works on a whole Arrow batch at once with numpy, so the cost per
word is a few nanoseconds and no Python object per word is made.

Null texts count as empty.  Empty batches and texts without words give empty
arrays.  Hashes are fixed by constants and agree between processes and runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_TABLES = [np.random.default_rng(s).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for s in (11, 12)]
_BASES = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)]
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int, which: int) -> np.ndarray:
    have = _POWERS.get(which)
    if have is None or len(have) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        have = np.full(size, _BASES[which], dtype=np.uint64)
        have[0] = 1
        _POWERS[which] = have = np.multiply.accumulate(have)
    return have


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, joined with one space after each, and the start of each text (one more at the end)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    raw = texts.buffers()
    offsets = np.frombuffer(raw[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    n = len(texts)
    out = np.full(int(offsets[-1] - offsets[0]) + n, 0x20, dtype=np.uint8)
    starts = offsets - offsets[0] + np.arange(n + 1)
    for i in range(n):
        out[starts[i] : starts[i + 1] - 1] = data[offsets[i] : offsets[i + 1]]
    return out, starts


class Words:
    """Words of a batch of texts: byte ranges [start, end), and first[i]:first[i + 1] are the words of text i."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        self.data, self.at = text_bytes(texts)
        if lower:
            self.data = _LOWER[self.data]
        inside = ~_SPACE[self.data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]  # the last byte of a batch is a space
        self.first = np.searchsorted(self.start, self.at)
        self.counts = np.diff(self.first)

    def hashes(self, which: int = 0) -> np.ndarray:
        """One 64-bit hash a word, in slices so that memory stays near 100 MB."""
        out = np.empty(len(self.start), dtype=np.uint64)
        step = 200_000
        for a in range(0, len(out), step):
            s, e = self.start[a : a + step], self.end[a : a + step]
            size = e - s
            begin = np.cumsum(size) - size
            within = np.arange(int(size.sum())) - np.repeat(begin, size)
            value = _TABLES[which][self.data[np.repeat(s, size) + within]] * _powers(int(size.max()) + 1, which)[within]
            out[a : a + step] = mix(np.add.reduceat(value, begin) + size.astype(np.uint64))
        return out


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k consecutive values; empty if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total = total * _BASES[1] + h[i : i + n]
    return mix(total)
