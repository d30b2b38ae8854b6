"""An FM-index over sequences of numbers, searched for many patterns at once."""

from __future__ import annotations

import numpy as np

U = np.uint64


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Suffixes of ``codes`` in order, by prefix doubling."""
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        changes = np.diff(key[order]) != 0
        rank[order] = np.concatenate([[0], np.cumsum(changes)])
        if changes.all():
            return order
        step *= 2


class WaveletMatrix:
    """Wavelet tree in matrix form: a packed bit vector with rank counts per level."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.bits = max(1, int(alphabet - 1).bit_length())
        self.levels = []
        n = len(symbols)
        for b in reversed(range(self.bits)):
            ones = (symbols >> b) & 1
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            flat = np.packbits(ones.astype(np.uint8), bitorder="little")
            packed[: len(flat)] = flat
            words = packed.view(np.uint64)
            before = np.zeros(len(words), np.int32)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            self.levels.append((b, words, before, n - int(ones.sum())))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])
        self.starts = self._descend(np.arange(alphabet), np.zeros(alphabet, np.int64))

    def _descend(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        for b, words, before, zeros in self.levels:
            word = places >> 6
            mask = (U(1) << (places & 63).astype(np.uint64)) - U(1)
            ones = before[word] + np.bitwise_count(words[word] & mask)
            places = np.where((symbols >> b) & 1, zeros + ones, places - ones)
        return places

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        return self._descend(symbols, places) - self.starts[symbols]


class FMIndex:
    """Index of ``codes``; the code 0 separates sequences and must end the last one."""

    def __init__(self, codes: np.ndarray):
        self.suffixes = suffix_array(codes)
        alphabet = int(codes.max()) + 1
        self.tree = WaveletMatrix(codes[self.suffixes - 1], alphabet)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=alphabet))])

    def search(self, patterns: np.ndarray, until_one: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the suffix array that begin with each row of ``patterns``, by backward search.

        ``until_one`` ends a row's search when one place is left; its range is then
        that of the end of the pattern, which stands nowhere else.
        """
        last = patterns[:, -1]
        low, high = self.first[last], self.first[last + 1]
        rows = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 2, -1, -1):
            if until_one:
                rows = rows[high[rows] - low[rows] > 1]
            symbols = patterns[rows, k]
            low[rows] = self.first[symbols] + self.tree.rank(symbols, low[rows])
            high[rows] = self.first[symbols] + self.tree.rank(symbols, high[rows])
        return low, high
