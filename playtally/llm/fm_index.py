"""FM-index over a sequence of small integers, with every query vectorised over many patterns."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start of every suffix in lexicographic order, by prefix doubling.

    The last value must be smaller than all others, so that no two suffixes are equal.
    """
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate(([0], np.diff(key[order]) != 0)))
        if n == 0 or new[order[-1]] == n - 1:
            return order
        rank, step = new, 2 * step


class WaveletTree:
    """Rank of any symbol before any position; one bit level after another, zeros moved to the front."""

    def __init__(self, values: np.ndarray, symbols: int):
        self._levels = []
        for bit in reversed(range(max(1, int(symbols - 1).bit_length()))):
            ones = ((values >> bit) & 1).astype(bool)
            counts = np.concatenate(([0], np.cumsum(ones))).astype(np.int64)
            self._levels.append((bit, counts, len(values) - counts[-1]))
            values = np.concatenate((values[~ones], values[ones]))

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position."""
        low = np.zeros(len(position), np.int64)
        for bit, counts, zeros in self._levels:
            one = ((symbol >> bit) & 1).astype(bool)
            position = np.where(one, zeros + counts[position], position - counts[position])
            low = np.where(one, zeros + counts[low], low - counts[low])
        return position - low


class FMIndex:
    """Index of `text`, values of which are 1 ... symbols - 1; 0 is kept for the end mark."""

    SAMPLE = 8

    def __init__(self, text: np.ndarray, symbols: int):
        text = np.concatenate((text, [0])).astype(np.int64)
        order = suffix_order(text)
        self._last = text[order - 1]
        self._tree = WaveletTree(self._last, symbols)
        self._before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))
        sampled = order % self.SAMPLE == 0
        self._sampled = sampled
        self._sample_rank = np.cumsum(sampled) - 1
        self._samples = order[sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the patterns, searched from their last symbol to the first.

        patterns[i, :lengths[i]] are the symbols of pattern i, all of them greater than 0.
        """
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), len(self._last), np.int64)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            symbol = patterns[live, lengths[live] - back]
            low[live] = self._before[symbol] + self._tree.rank(symbol, low[live])
            high[live] = self._before[symbol] + self._tree.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walks back to the next sampled suffix."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self._sampled[rows])
        while len(walking):
            symbol = self._last[rows[walking]]
            rows[walking] = self._before[symbol] + self._tree.rank(symbol, rows[walking])
            steps[walking] += 1
            walking = walking[~self._sampled[rows[walking]]]
        return self._samples[self._sample_rank[rows]] + steps
