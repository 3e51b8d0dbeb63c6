"""Prediction by partial matching over bytes: a context trie in sorted arrays, with escapes and symbol exclusion."""

from __future__ import annotations

import numpy as np

#: A symbol takes nine bits: 0 stands before a text, a byte is its value plus one, END closes the text.
BITS, END, ALPHABET = 9, 257, 257


def grams(text: bytes, order: int) -> np.ndarray:
    """For each symbol of a text and its end: the ``order`` symbols before it and itself, packed."""
    symbols = np.zeros(order + len(text) + 1, np.uint64)
    symbols[order:-1] = np.frombuffer(text, np.uint8)
    symbols[order:-1] += np.uint64(1)
    symbols[-1] = END
    return pack(symbols, order)


def pack(symbols: np.ndarray, order: int) -> np.ndarray:
    n = len(symbols) - order
    packed = symbols[:n].copy()
    for k in range(1, order + 1):
        packed <<= np.uint64(BITS)
        packed |= symbols[k : k + n]
    return packed


def _mask(symbols: int) -> np.uint64:
    return np.uint64((1 << BITS * symbols) - 1)


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted table, and whether they are there."""
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, (table[at] == keys) if len(table) else np.zeros(len(keys), bool)


class Trie:
    """Counts of all orders, compiled to logarithms.

    ``counted[j]`` holds the sorted grams of order ``j`` (context of ``j``
    symbols and the symbol) and their counts; a gram's shorter forms are there
    as well, with counts no smaller.
    """

    def __init__(self, counted: list[tuple[np.ndarray, np.ndarray]]):
        self.order = len(counted) - 1
        self.grams, self.gram_log, self.gram_top = [], [], []
        self.contexts, self.escape, self.next_escape, self.next_total = [], [], [], []
        lower = None
        for order, (keys, counts) in enumerate(counted):
            context = keys >> np.uint64(BITS)
            contexts, first, kinds = np.unique(context, return_index=True, return_counts=True)
            total = np.add.reduceat(counts, first) if len(keys) else np.empty(0, np.int64)
            logs = np.log10(counts)
            self.grams.append(keys)
            self.gram_log.append(logs)
            self.gram_top.append(logs - np.repeat(np.log10(total + kinds), kinds))
            self.contexts.append(contexts)
            self.escape.append(np.log10(kinds / (total + kinds)))
            # what is left one order below once this context's symbols are excluded
            if order:
                low_keys, low_counts, low_contexts, low_total, low_kinds = lower
                shared = low_counts[find(low_keys, keys & _mask(order))[0]]
                parent = find(low_contexts, contexts & _mask(order - 1))[0]
                rest = low_total[parent] - (np.add.reduceat(shared, first) if len(keys) else 0)
                rest_kinds = low_kinds[parent] - kinds
                weight = np.maximum(rest + rest_kinds, 1)
                self.next_total.append(np.log10(weight))
                # nothing new below: the escape goes on at no cost
                self.next_escape.append(np.where(rest_kinds > 0, np.log10(np.maximum(rest_kinds, 1) / weight), 0.0))
            else:
                self.next_total.append(None)
                self.next_escape.append(None)
            lower = keys, counts, contexts, total, kinds
        self.unseen = -np.log10(max(1, ALPHABET - len(counted[0][0])))

    def log_probabilities(self, packed: np.ndarray) -> np.ndarray:
        """log10 of each symbol's probability after its context; grams are packed with the trie's order."""
        distinct, place = np.unique(packed, return_inverse=True)
        return self._look_up(distinct)[place]

    def _look_up(self, packed: np.ndarray) -> np.ndarray:
        out = np.zeros(len(packed))
        open_ = np.arange(len(packed))
        denominator = np.full(len(packed), np.nan)  # of the next order, after an escape
        escape = np.zeros(len(packed))
        for order in range(self.order, -1, -1):
            keys = packed[open_] & _mask(order + 1)
            at, found = find(self.grams[order], keys)
            hit, place = open_[found], at[found]
            fresh = np.isnan(denominator[hit])
            out[hit] += np.where(fresh, self.gram_top[order][place], self.gram_log[order][place] - denominator[hit])
            open_, keys = open_[~found], keys[~found]
            if not len(open_):
                return out
            at, known = find(self.contexts[order], keys >> np.uint64(BITS))
            here, place = open_[known], at[known]
            fresh = np.isnan(denominator[here])
            out[here] += np.where(fresh, self.escape[order][place], escape[here])
            if order:
                denominator[here] = self.next_total[order][place]
                escape[here] = self.next_escape[order][place]
        out[open_] += self.unseen
        return out
