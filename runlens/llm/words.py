"""Hashes of the words of many texts at once, for the operators on word sequences.

Words are the maximal runs of bytes other than space, tab, line feed, vertical tab,
form feed and carriage return. A word's hash is a polynomial over its bytes modulo
2^64, taken from one running sum per block of texts, then mixed. Such polynomials collide on
long structured words whatever their base, so words of more than ``LONGEST`` bytes are
hashed by BLAKE2b. Operators use these hashes to find candidates and compare the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
LONGEST = 16
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_BYTES_LOWER = _BYTES.copy()
_BYTES_LOWER[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n, U(base))
    powers[:1] = 1
    return np.cumprod(powers, dtype=np.uint64)


class WordHasher:
    """Blocks of texts as ``(first text, words' hashes, texts' first words)``."""

    def __init__(self, lower: bool = False, block: int = 1 << 20):
        self.lower = lower
        self.table = _BYTES_LOWER if lower else _BYTES
        self.block = block
        self._sized(1 << 12)

    def _sized(self, n: int) -> None:
        self.powers, self.inverses = _powers(_BASE, n), _powers(_BASE_INVERSE, n)

    def blocks(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """A block has ``block`` bytes, or one longer text; nulls must not be there."""
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if texts.buffers()[2] is None:
            data = np.zeros(0, np.uint8)
        else:
            data = np.frombuffer(texts.buffers()[2], np.uint8)
        first = 0
        while first < len(texts):
            last = int(np.searchsorted(offsets, offsets[first] + self.block, side="right")) - 1
            last = min(max(last, first + 1), len(texts))
            part = offsets[first : last + 1]
            yield first, *self._hash(data[part[0] : part[-1]], part - part[0])
            first = last

    def _hash(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if n == 0:
            return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
        if n > len(self.powers):
            self._sized(max(n, self.block))
        gap = np.empty(n + 1, bool)  # white space before a byte; a text begins after a gap
        gap[0], gap[1:] = True, _SPACE[data]
        inside = ~gap[1:]
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        starts = np.flatnonzero(inside & (gap[:-1] | edge[:-1]))
        after = np.empty(n, bool)
        after[:-1], after[-1] = gap[2:], True
        ends = np.flatnonzero(inside & (after | edge[1:])) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * self.powers[:n], out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * self.inverses[starts]
        hashes = mixed(hashes + (ends - starts).astype(np.uint64))
        for i in np.flatnonzero(ends - starts > LONGEST).tolist():
            word = data[starts[i] : ends[i]].tobytes()
            hashes[i] = int.from_bytes(blake2b(word.lower() if self.lower else word, digest_size=8).digest(), "little")
        return hashes, np.searchsorted(starts, bounds)
