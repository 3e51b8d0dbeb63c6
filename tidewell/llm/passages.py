"""Exact search for passages of many words that occur twice or more.

Every window of ``words`` words has one content-defined anchor, so equal
windows have equal anchors.  The windows that share an anchor at one place are
its context.  Contexts that are equal as a whole need counting only; of an
anchor's contexts that differ, one of each kind has its windows hashed and counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.anchors import sliding_min
from tidewell.sources.storage import cut_lineage, drop_table

#: Words of an anchor, at most; bits of its place, and windows handled at once.
GRAM_WORDS, _PLACE_BITS, _AT_ONCE = 12, 20, 1 << 19
_PLACES = np.uint64((1 << _PLACE_BITS) - 1)
#: Bytes summed at once, and the base of the sums with its inverse.
_BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of a text."""
    letters = np.frombuffer(data, np.uint8)
    inside = ~((letters == 32) | ((letters >= 9) & (letters <= 13)))
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def _powers(base: int) -> np.ndarray:
    return np.multiply.accumulate(np.array([1] + [base] * (_BLOCK - 1), np.uint64))


_FORWARD, _BACKWARD = _powers(_BASE), _powers(_INVERSE)


def _sums(letters: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Sums of letters times powers of the base before each of some ascending places of a text."""
    out, before = np.empty(len(places), np.uint64), 0
    for low in range(0, len(letters), _BLOCK):
        block = letters[low : low + _BLOCK].astype(np.uint64) + np.uint64(1)
        scale = pow(_BASE, low, 1 << 64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(block * _FORWARD[: len(block)])])
        i, j = np.searchsorted(places, (low, low + _BLOCK))
        out[i:j] = sums[places[i:j] - low] * np.uint64(scale) + np.uint64(before)
        before = (before + int(sums[-1]) * scale) % (1 << 64)
    return out


def _gram_hashes(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the strings from each start to its end, which depend on nothing around them."""
    blocks = np.array([pow(_INVERSE, low, 1 << 64) for low in range(0, len(letters), _BLOCK)], np.uint64)
    h = (_sums(letters, ends) - _sums(letters, starts)) * _BACKWARD[starts % _BLOCK] * blocks[starts // _BLOCK]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _joined(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Texts put together, each ended by a line feed, with their numbers and first places."""
    held: list[int] = []
    size = 0
    for number, text in enumerate(texts):
        held.append(number)
        size += len(text) + 1
        if size >= _BLOCK or number == len(texts) - 1:
            sizes = np.array([len(texts[k]) + 1 for k in held])
            yield b"\n".join([*(texts[k] for k in held), b""]), np.array(held), np.cumsum(sizes) - sizes
            held, size = [], 0


def passage_runs(texts: list[bytes], words: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of neighbouring windows with one anchor: joined texts, first place and end there, text number, first byte, hash."""
    width = min(GRAM_WORDS, words)
    for data, numbers, firsts in _joined(texts):
        letters = np.frombuffer(data, np.uint8)
        starts, ends = _bounds(data)
        for at in range(0, len(starts) - words + 1, _AT_ONCE):
            a, b = starts[at : at + _AT_ONCE + words - 1], ends[at : at + _AT_ONCE + words - 1]
            hashes = _gram_hashes(letters, a[: len(a) - width + 1], b[width - 1 :])
            # the place in the low bits: among equal hashes the last one is smallest
            keys = (hashes & ~_PLACES) | (_PLACES - np.arange(len(hashes), dtype=np.uint64))
            place = (_PLACES - (sliding_min(keys, words - width + 1) & _PLACES)).astype(np.int64)
            text = np.searchsorted(firsts, a, "right") - 1
            windows = np.flatnonzero(text[: len(place)] == text[words - 1 :])
            if not len(windows):
                continue
            place = place[windows]
            new = np.concatenate([[True], (place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1)])
            first, last = windows[new], windows[np.append(np.flatnonzero(new)[1:], len(windows)) - 1]
            number = text[first]
            yield data, a[first], b[last + words - 1], numbers[number], a[first] - firsts[number], hashes[place[new]]


_WINDOWS = "w1 long, w2 long, c1 long, c2 long, low int, high int, alone boolean"


def _windows(words: int):
    """One row per window; rows are ``c1, c2, body, alone``."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in _WINDOWS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                lows, highs, names = [], [], []
                for body in part[2].to_pylist():
                    starts, ends = _bounds(body)
                    lows.append(starts[: len(starts) - words + 1])
                    highs.append(ends[words - 1 :])
                    names += [xxhash.xxh3_128_digest(body[x:y]) for x, y in zip(lows[-1].tolist(), highs[-1].tolist(), strict=True)]
                w = np.frombuffer(b"".join(names), ">i8").reshape(-1, 2).astype(np.int64)
                of = pa.array(np.repeat(np.arange(len(lows)), [len(x) for x in lows]))
                c1, c2, alone = (part[k].take(of) for k in (0, 1, 3))
                columns = (w[:, 0], w[:, 1], c1, c2, np.concatenate(lows), np.concatenate(highs), alone)
                arrays = [(x if isinstance(x, pa.Array) else pa.array(x)).cast(f.type) for x, f in zip(columns, schema, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def passage_marks(bodies: DataFrame, words: int) -> DataFrame:
    """``c1, c2, low, high``: bytes of the strings of ``words`` words in ``bodies(c1, c2, copies, body)`` that start elsewhere too.

    ``c1, c2`` name bodies, one row each; ``copies`` is how often a body occurs.
    """
    whole = bodies.where("copies > 1").select("c1", "c2", F.lit(0).alias("low"), F.length("body").alias("high"))
    hashed = bodies.select("c1", "c2", "body", (F.col("copies") == 1).alias("alone")).mapInArrow(_windows(words), _WINDOWS)
    hashed = cut_lineage(hashed)
    twice = hashed.groupBy("w1", "w2").agg(F.count("*").alias("m")).where("m > 1").select("w1", "w2")
    marks = hashed.where("alone").join(cut_lineage(twice), ["w1", "w2"])
    marks = cut_lineage(whole.union(marks.select("c1", "c2", "low", "high")))
    drop_table(hashed)
    return marks
