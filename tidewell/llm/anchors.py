"""Content-defined anchors: equal strings of the window length pick equal anchors, wherever they start."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of an anchor. A window's anchor is the last of its smallest hashed grams.
GRAM = 32
_BASE = 0x9E3779B97F4A7C15 | 1
_PLACE_BITS = 20
_PLACES = np.uint64((1 << _PLACE_BITS) - 1)
#: Window starts handled at once; places within it fit PLACE_BITS.
AT_ONCE = 1 << 19


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of all GRAM-byte strings."""
    h = data.astype(np.uint64) + np.uint64(1)
    length, factor = 1, _BASE
    while length < GRAM:
        h = h[:-length] * np.uint64(factor) + h[length:]
        factor = factor * factor % (1 << 64)
        length *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    least, length = values, 1
    while 2 * length <= width:
        least = np.minimum(least[:-length], least[length:])
        length *= 2
    rest = width - length
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def segments(texts: list[bytes], window: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Joined texts of bounded size: ``(bytes, text number, offset in the text, valid window starts)`` by position."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def out():
        data = b"".join(t for _, _, t in held)
        sizes = np.array([len(t) for _, _, t in held])
        firsts = np.cumsum(sizes) - sizes
        which = np.repeat([i for i, _, _ in held], sizes)
        offset = np.arange(len(data)) + np.repeat([o for _, o, _ in held] - firsts, sizes)
        left = np.repeat(firsts + sizes, sizes) - np.arange(len(data))
        return data, which, offset, left >= window

    for number, text in enumerate(texts):
        for at in range(0, max(1, len(text) - window + 1), AT_ONCE):
            piece = text[at : at + AT_ONCE + window - 1]
            if len(piece) < window:
                continue
            if size + len(piece) > 1 << _PLACE_BITS:
                yield out()
                held, size = [], 0
            held.append((number, at, piece))
            size += len(piece)
    if held:
        yield out()


def anchor_runs(data: bytes, valid: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows with one anchor: first start, number of starts, anchor place, anchor hash."""
    hashes = gram_hashes(np.frombuffer(data, np.uint8))
    places = np.arange(len(hashes), dtype=np.uint64)
    # the place in the low bits: among equal hashes the last one is smallest
    keys = (hashes & ~_PLACES) | (_PLACES - places)
    least = sliding_min(keys, window - GRAM + 1)
    place = (_PLACES - (least & _PLACES)).astype(np.int64)
    starts = np.flatnonzero(valid[: len(place)])
    place = place[starts]
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(starts)))
    return starts[first], counts, place[first], hashes[place[first]]
