"""A run-length index of repetitive text: run-compressed BWT with sampled run ends, and matching statistics from it."""

from __future__ import annotations

import numpy as np


class RunIndex:
    """Index over several byte strings of at most ``longest`` bytes, each ended by a mark of its own.

    Only the ends of the runs of the Burrows-Wheeler transform are kept: for
    each run head its text position, the position of the suffix just before
    it in sorted order, and the length both share.
    """

    def __init__(self, strings: list[bytes], longest: int):
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        ends = np.cumsum(lengths + 1) - 1
        self.starts = ends - lengths
        data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64)
        symbols = data + len(strings)
        symbols[ends] = np.arange(len(strings))  # end marks differ from all else and from one another
        self.size = len(symbols)
        self._symbols = symbols
        self._ranks = self._double(symbols, len(strings) + 256, longest)
        self.heads, self.before, self.shared = self._runs()

    def _double(self, symbols: np.ndarray, most: int, longest: int) -> list[tuple[int, np.ndarray]]:
        """Ranks of all substrings of length 4, 8, 16 ... until every suffix has its own."""
        padded = np.concatenate([symbols, np.zeros(4, np.int64)])
        n, width = self.size, most + 1
        keys = padded[:n]
        for step in (1, 2, 3):
            keys = keys * width + padded[step : n + step]
        ranks, length = [], 4
        while True:
            order = np.argsort(keys)
            sorted_keys = keys[order]
            dense = np.zeros(n, np.int64)
            dense[order] = np.concatenate([[0], np.cumsum(sorted_keys[1:] != sorted_keys[:-1])])
            ranks.append((length, dense.astype(np.int32)))
            if length > longest or dense[order[-1]] == n - 1:
                self._order = order
                return ranks
            after = np.zeros(n, np.int64)
            after[: n - length] = dense[length:] + 1
            keys = dense * (n + 1) + after
            length *= 2

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at ``a`` and ``b``."""
        a, b, start = a.copy(), b.copy(), a
        for length, rank in [*reversed(self._ranks), *[(1, self._symbols)] * 3]:
            inside = (a < self.size) & (b < self.size)
            same = np.zeros(len(a), bool)
            same[inside] = rank[a[inside]] == rank[b[inside]]
            a += same * length
            b += same * length
        return a - start

    def _runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        transform = self._symbols[self._order - 1]
        at = np.flatnonzero(transform[1:] != transform[:-1]) + 1
        head, before = self._order[at], self._order[at - 1]
        by_place = np.argsort(head)
        head, before = head[by_place], before[by_place]
        return head, before, self._common(head, before)

    def repeats(self, length: int) -> np.ndarray:
        """For every text position: does the string of ``length`` bytes there start anywhere else as well?

        The statistics of a position that is no run head follow from the head
        before it in the text: both suffixes move on by one byte and share
        one less.
        """
        marks = np.zeros(self.size, bool)
        if not len(self.heads):
            return marks
        place = np.arange(self.heads[0], self.size)
        run = np.searchsorted(self.heads, place, "right") - 1
        moved = place - self.heads[run]
        long = self.shared[run] - moved >= length
        marks[place[long]] = True
        marks[(self.before[run] + moved)[long]] = True
        return marks
