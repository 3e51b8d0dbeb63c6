"""Gray-order hierarchical index over 64-bit codes: which codes lie within a distance, as components."""

from __future__ import annotations

import numpy as np

LEAF, FANOUT = 32, 8
_PAIRS_AT_ONCE = 1 << 20


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order; neighbours in that order differ in few bits."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _fold(pattern: np.ndarray, mask: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes over runs of ``width``: the bits all members share (mask) and their values (pattern)."""
    starts = np.arange(0, len(pattern), width)
    head = np.repeat(pattern[starts], width)[: len(pattern)]
    shared = ~np.bitwise_or.reduceat((pattern ^ head) | ~mask, starts)
    return pattern[starts] & shared, shared


class GrayIndex:
    """Codes in Gray order; ``levels[0]`` are runs of LEAF codes, each higher node covers FANOUT lower ones."""

    def __init__(self, codes: np.ndarray):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.codes = codes[self.order]
        full = np.full(len(codes), ~np.uint64(0), np.uint64)
        self.levels = [_fold(self.codes, full, LEAF)]
        while len(self.levels[-1][0]) > FANOUT:
            self.levels.append(_fold(*self.levels[-1], FANOUT))


def _children(a: np.ndarray, b: np.ndarray, width: int, n_a: int, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    steps = np.arange(width)
    left = np.repeat(a[:, None] * width + steps, width, axis=1).ravel()
    right = np.tile(b[:, None] * width + steps, width).ravel()
    real = (left < n_a) & (right < n_b)
    return left[real], right[real]


def _settle(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the pairs: the smallest position of each component."""
    while True:
        low = np.minimum(labels[a], labels[b])
        new = labels.copy()
        for side in (a, b):
            np.minimum.at(new, labels[side], low)
            np.minimum.at(new, side, low)
        while not np.array_equal(new[new], new):
            new = new[new]
        if np.array_equal(new, labels):
            return labels
        labels = new


def linked(
    first: np.ndarray,
    distance: int,
    second: np.ndarray | None = None,
    shade: tuple[int, np.ndarray, np.ndarray | None] | None = None,
) -> np.ndarray:
    """Component labels of ``first`` (or ``first`` and ``second`` laid end to end).

    Two codes are linked if they differ in at most ``distance`` bits; with
    ``second`` given, only links between the two sides count.  A label is the
    smallest position in the component.  Pairs of nodes are walked from the
    top; a pair goes as soon as the bits both nodes share differ too often, or
    once all their codes are in one component.  ``shade`` gives a second distance, and second codes of
    ``first`` and ``second``, that a link must keep too.
    """
    same = second is None
    left = GrayIndex(first)
    right = left if same else GrayIndex(second)
    place_l = left.order
    place_r = left.order if same else right.order + len(first)
    labels = np.arange(len(first) + (0 if same else len(second)))
    if shade is not None:
        shades = shade[1] if same else np.concatenate(shade[1:])
    top_l, top_r = len(left.levels) - 1, len(right.levels) - 1
    top = min(top_l, top_r)
    a, b = np.meshgrid(np.arange(len(left.levels[top][0])), np.arange(len(right.levels[top][0])), indexing="ij")
    work = [(top, a.ravel(), b.ravel())]
    while work:
        level, a, b = work.pop()
        width = LEAF if level == 0 else FANOUT
        most = max(1, _PAIRS_AT_ONCE // width**2)
        if len(a) > most:
            work.append((level, a[most:], b[most:]))
            a, b = a[:most], b[:most]
        (pat_l, mask_l), (pat_r, mask_r) = left.levels[level], right.levels[level]
        near = np.bitwise_count((pat_l[a] ^ pat_r[b]) & mask_l[a] & mask_r[b]) <= distance
        if same:
            near &= a <= b
        a, b = a[near], b[near]
        if level == 0 and len(a):
            span = lambda place: (np.minimum.reduceat(labels[place], s), np.maximum.reduceat(labels[place], s))
            s = np.arange(0, len(place_l), LEAF)
            low_l, high_l = span(place_l)
            s = np.arange(0, len(place_r), LEAF)
            low_r, high_r = span(place_r)
            open_ = ~((low_l[a] == high_r[b]) & (high_l[a] == low_r[b]) & (low_l[a] == high_l[a]))
            a, b = a[open_], b[open_]
        if not len(a):
            continue
        if level:
            below = level - 1
            work.append((below, *_children(a, b, FANOUT, len(left.levels[below][0]), len(right.levels[below][0]))))
            continue
        i, j = _children(a, b, LEAF, len(left.codes), len(right.codes))
        close = np.bitwise_count(left.codes[i] ^ right.codes[j]) <= distance
        i, j = place_l[i[close]], place_r[j[close]]
        if shade is not None:
            close = np.bitwise_count(shades[i] ^ shades[j]) <= shade[0]
            i, j = i[close], j[close]
        apart = labels[i] != labels[j]
        if apart.any():
            labels = _settle(labels, i[apart], j[apart])
    return labels
