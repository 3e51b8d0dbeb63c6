"""Bounded-space online packing of token sequences (operator 1)."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.columns import only
from tidewell.llm.tokens import word_encoder
from tidewell.sources.storage import cut_lineage

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_OPEN = PIECE + ", part long, ids binary"
#: Partitions whose left-over windows are merged in one task.
MERGED_TOGETHER = 64


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())


class Packer:
    """Keeps at most ``most_open`` windows; a piece is ``(doc_id, start, doc_tokens, ids)``."""

    def __init__(self, size: int, most_open: int):
        self.size, self.most_open = size, most_open
        self.rooms: list[tuple[int, int]] = []  # (room left, window), sorted
        self.windows: dict[int, list] = {}
        self.made = 0

    def _open(self) -> None:
        self.windows[self.made] = []
        insort(self.rooms, (self.size, self.made))
        self.made += 1

    def _put(self, at: int, piece) -> list | None:
        """Put a piece into the window at a place of ``rooms``; returns its pieces once it is full."""
        room, window = self.rooms.pop(at)
        self.windows[window].append(piece)
        room -= len(piece[3])
        if room:
            insort(self.rooms, (room, window))
            return None
        return self.windows.pop(window)

    def add(self, piece) -> Iterator[list]:
        """Place a piece of any length; yields the windows that are emitted."""
        doc_id, start, n, ids = piece
        while len(ids) >= self.size:
            yield [(doc_id, start, n, ids[: self.size])]
            start, ids = start + self.size, ids[self.size :]
        if not len(ids):
            return
        at = bisect_left(self.rooms, (len(ids), -1))  # the tightest window that still fits
        if at == len(self.rooms):
            if len(self.rooms) == self.most_open:
                # none fits: the fullest window is topped up with the front of the piece and goes out
                room = self.rooms[0][0]
                yield self._put(0, (doc_id, start, n, ids[:room]))
                start, ids = start + room, ids[room:]
            self._open()
            at = bisect_left(self.rooms, (len(ids), -1))
        full = self._put(at, (doc_id, start, n, ids))
        if full:
            yield full


def _rows(window: list, sequence: int, part: int | None = None) -> list[tuple]:
    """Rows of a window; with ``part`` its ids go along, as it isn't final."""
    rows, offset = [], 0
    for doc_id, start, n, ids in window:
        tail = () if part is None else (part, ids.astype("<u4").tobytes())
        rows.append((doc_id, start, len(ids), crc_of(ids), n, sequence, offset, *tail))
        offset += len(ids)
    return rows


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _schema(opened: bool) -> pa.Schema:
    fields = [(part.split()[0], pa.int64()) for part in PIECE.split(", ")]
    return pa.schema(fields + [("part", pa.int64()), ("ids", pa.binary())] if opened else fields)


def _pack_partition(tokenizer: str, end_id: int, size: int, most_open: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, schema, part = word_encoder(tokenizer), _schema(True), TaskContext.get().partitionId()
        packer, rows, sequence = Packer(size, most_open), [], part << 32
        for batch in batches:
            for doc_id, text in zip(batch[0].to_pylist(), batch[1].cast(pa.binary()), strict=True):
                ids = np.append(encoder.ids(text.as_py()), np.array(end_id, encoder.dtype))
                for window in packer.add((doc_id, 0, len(ids), ids)):
                    rows += [(*r, None, None) for r in _rows(window, sequence)]
                    sequence += 1
                if len(rows) > 20_000:
                    yield _batch(rows, schema)
                    rows = []
        for at, window in packer.windows.items():
            rows += _rows(window, at, part)
        yield _batch(rows, schema)

    return run


def _merge_left_over(size: int):
    """Lay the left-over pieces end to end and cut at full windows; the last one is cut at powers of two."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("sequence_id", "ascending"), ("offset", "ascending")])
        group, sequence, rows = key[0].as_py(), 0, []
        pieces = [
            (r["doc_id"], r["start"], r["doc_tokens"], np.frombuffer(r["ids"], "<u4")) for r in table.to_pylist()
        ]
        left = sum(len(p[3]) for p in pieces)
        window, room = [], 0
        for doc_id, start, n, ids in pieces:
            while len(ids):
                if not room:
                    room = size if left >= size else 1 << (left.bit_length() - 1)
                    left -= room
                window.append((doc_id, start, n, ids[:room]))
                taken = min(room, len(ids))
                start, ids, room = start + taken, ids[taken:], room - taken
                if not room:
                    rows += _rows(window, 1 << 62 | group << 32 | sequence)
                    window, sequence = [], sequence + 1
        schema = _schema(False)
        return pa.Table.from_batches([_batch(rows, schema)], schema)

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = 2048, most_open: int = 32) -> DataFrame:
    """Pieces of ``docs(doc_id, text)`` packed into windows of ``size`` tokens.

    Every partition is read once, in order, with ``most_open`` open windows:
    a piece goes to the tightest window that holds it; if there is none, the
    fullest window is topped up with the front of the piece and emitted.
    What is still open at the end of a partition, at most ``most_open``
    windows, is merged over MERGED_TOGETHER partitions.  No window has padding
    but the last ones, whose lengths are powers of two.

    Null and empty texts are documents of the end id alone; a text of any
    length is cut into as many pieces as needed; repeated rows are packed as
    often as they occur; other columns are not read; no rows give none.
    """
    packed = only(docs, "doc_id", "text").mapInArrow(_pack_partition(tokenizer, end_id, size, most_open), _OPEN)
    packed = cut_lineage(packed)
    done = packed.where(F.col("part").isNull()).drop("part", "ids")
    group = F.floor(F.col("part") / MERGED_TOGETHER)
    left = packed.where(F.col("part").isNotNull()).withColumn("merged", group)
    return done.union(left.groupBy("merged").applyInArrow(_merge_left_over(size), PIECE))
