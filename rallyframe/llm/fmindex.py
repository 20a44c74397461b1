"""An FM-index over a sequence of numbers: backward search through wavelet ranks, positions from samples."""

from __future__ import annotations

import numpy as np

#: Every so many positions of the text one suffix position is kept.
SAMPLE = 8


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The starts of the suffixes in order, by prefix doubling; the last number must be less than all others."""
    _, rank = np.unique(text, return_inverse=True)
    n, step = len(text), 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = rank[step:] + 1 if step < n else 0
        key = rank * np.int64(n + 1) + ahead
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Counts and finds patterns in a text of numbers 1 to size - 1; 0 is the end mark that is added."""

    def __init__(self, text: np.ndarray, size: int):
        text = np.append(text, 0)
        order = suffix_order(text)
        self.n = len(text)
        self.last = text[order - 1]  # the number before each suffix, in suffix order
        self.below = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=size))))
        kept = order % SAMPLE == 0
        self.kept, self.kept_before = kept, np.cumsum(kept) - kept
        self.samples = order[kept]
        self.levels: list[tuple[int, int, np.ndarray]] = []
        row = self.last
        for level in reversed(range(max(1, int(size - 1).bit_length()))):
            bit = (row >> level) & 1 == 1
            ones = np.concatenate(([0], np.cumsum(bit, dtype=np.int32)))
            self.levels.append((level, self.n - int(ones[-1]), ones))
            row = np.concatenate((row[~bit], row[bit]))

    def rank(self, number: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each number is among the first `upto` of `last`: one step for each level of the wavelet tree."""
        first = np.zeros(len(number), np.int64)
        for level, zeros, ones in self.levels:
            bit = (number >> level) & 1 == 1
            a, b = ones[first], ones[upto]
            first = np.where(bit, zeros + a, first - a)
            upto = np.where(bit, zeros + b, upto - b)
        return upto - first

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of suffixes that begin with each pattern (one for each row), last number first."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for k in reversed(range(patterns.shape[1])):
            number = patterns[live, k]
            low[live] = self.below[number] + self.rank(number, low[live])
            high[live] = self.below[number] + self.rank(number, high[live])
            live = live[high[live] > low[live]]
            if not len(live):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text positions of suffixes: back through the text to the next sampled one."""
        rows = rows.copy()
        steps = np.zeros(len(rows), np.int64)
        live = np.flatnonzero(~self.kept[rows])
        while len(live):
            number = self.last[rows[live]]
            rows[live] = self.below[number] + self.rank(number, rows[live])
            steps[live] += 1
            live = live[~self.kept[rows[live]]]
        return self.samples[self.kept_before[rows]] + steps
