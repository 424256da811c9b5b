"""A compressed full-text index of word runs: Burrows-Wheeler transform over a wavelet matrix of packed bits."""

import numpy as np


def suffix_order(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """The order of all suffixes, or of their first ``depth`` words at least, by doubling the length that ranks speak for."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        ahead = np.full(n, -1, np.int64)
        ahead[: n - step] = rank[step:]
        key = rank * (n + 1) + ahead + 1
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        step *= 2
        if fresh[-1] == n - 1 or step >= (depth or 2 * n):
            return order


class Wavelet:
    """How often a symbol occurs before a place. One row of bits for each binary digit, most significant first; zeros
    go before ones from row to row. Counts of ones are kept for each 64 bits."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.rows = []
        self.start = np.zeros(largest + 1, np.int64)  # where the occurrences of each symbol begin after the last row
        every = np.arange(largest + 1)
        for shift in range(max(1, int(largest).bit_length()) - 1, -1, -1):
            bit = (symbols >> shift & 1).astype(np.uint8)
            padded = np.zeros((len(bit) // 64 + 1) * 64, np.uint8)
            padded[: len(bit)] = bit
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.rows.append((shift, packed, before, int(len(bit) - bit.sum())))
            self.start = self._step(self.rows[-1], every >> shift & 1 == 1, self.start)
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    @staticmethod
    def _step(row: tuple, one: np.ndarray, place: np.ndarray) -> np.ndarray:
        _, packed, before, zeros = row
        block = place >> 6
        ones = before[block] + np.bitwise_count(packed[block] & ((np.uint64(1) << (place & 63).view(np.uint64)) - np.uint64(1)))
        return np.where(one, ones + zeros, place - ones)

    def rank(self, symbol: np.ndarray, places: list[np.ndarray]) -> list[np.ndarray]:
        """For each query, occurrences of ``symbol`` among the first ``place`` ones, for each of the ``places``."""
        for row in self.rows:
            one = (symbol >> row[0] & 1).astype(bool)
            places = [self._step(row, one, p) for p in places]
        return [p - self.start[symbol] for p in places]


class FMIndex:
    """The index of ``text``, whole numbers from 0; 0 stands between runs and is never searched for. ``depth``: most words searched for."""

    def __init__(self, text: np.ndarray, depth: int | None = None):
        order = suffix_order(text, depth)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text))])
        self.wavelet = Wavelet(text[order - 1], int(text.max()))
        self.size = len(text)

    def search(self, text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of the ``length`` words of ``text`` from each start: the ranges of suffixes they begin."""
        last = text[starts + length - 1]
        low, high = self.first[last], self.first[last + 1]
        for i in range(length - 2, -1, -1):
            c = text[starts + i]
            low, high = (self.first[c] + r for r in self.wavelet.rank(c, [low, high]))
        return low, high
