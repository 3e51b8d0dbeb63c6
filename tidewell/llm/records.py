"""Token ids as length-delimited binary records with an offset index (operator 6).

A shard ``part-*.rec`` is a run of frames::

    length  u64 little-endian     bytes of the payload
    check   u32                   masked CRC-32 of the length field
    payload                       has_id u8, doc_id i64, width u8, ids (width bytes each, little-endian)
    check   u32                   masked CRC-32 of the payload

Its ``part-*.idx`` holds the u64 offset of every frame and a masked CRC-32 of
them all, so that readers can visit records in any order.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.columns import only
from tidewell.llm.tokens import word_encoder
from tidewell.sources.storage import cut_lineage, shared_dir

_LENGTH, _CHECK, _HEAD = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<BqB")
_MASK = 0xA282EAD8
_FLUSH = 1 << 20


def masked(data: bytes) -> int:
    """CRC-32 turned by 15 bits plus a constant, so that checks of data holding checks stay useful."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK) & 0xFFFFFFFF


def payload(doc_id: int | None, ids: np.ndarray) -> bytes:
    return _HEAD.pack(doc_id is not None, doc_id or 0, ids.dtype.itemsize) + ids.tobytes()


def parse(data: bytes) -> tuple[int | None, np.ndarray]:
    has_id, doc_id, width = _HEAD.unpack_from(data)
    return (doc_id if has_id else None), np.frombuffer(data, f"<u{width}", offset=_HEAD.size)


def frame(data: bytes) -> bytes:
    length = _LENGTH.pack(len(data))
    return length + _CHECK.pack(masked(length)) + data + _CHECK.pack(masked(data))


def write_shard(fs: FileSystem, path: str, payloads: Iterable[bytes]) -> list[int]:
    """Write a shard and its index; returns the frames' offsets."""
    offsets, at, held, n = [], 0, [], 0
    with fs.open_output_stream(f"{path}.rec") as out:
        for data in payloads:
            framed = frame(data)
            offsets.append(at)
            at += len(framed)
            held.append(framed)
            n += len(framed)
            if n > _FLUSH:
                out.write(b"".join(held))
                held, n = [], 0
        out.write(b"".join(held))
    index = np.array(offsets, "<u8").tobytes()
    with fs.open_output_stream(f"{path}.idx") as out:
        out.write(index + _CHECK.pack(masked(index)))
    return offsets


def read_index(fs: FileSystem, path: str) -> np.ndarray:
    with fs.open_input_stream(f"{path}.idx") as f:
        data = f.read()
    index, (check,) = data[:-4], _CHECK.unpack(data[-4:])
    if masked(index) != check:
        raise ValueError(f"damaged index: {path}.idx")
    return np.frombuffer(index, "<u8")


def _next(f, path: str) -> bytes | None:
    head = f.read(_LENGTH.size + _CHECK.size)
    if not head:
        return None
    if len(head) < 12 or masked(head[:8]) != _CHECK.unpack(head[8:])[0]:
        raise ValueError(f"damaged length: {path}.rec")
    n = _LENGTH.unpack(head[:8])[0]
    data = f.read(n + 4)
    if len(data) != n + 4 or masked(data[:n]) != _CHECK.unpack(data[n:])[0]:
        raise ValueError(f"damaged record: {path}.rec")
    return data[:n]


def read_shard(fs: FileSystem, path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """All records in file order."""
    with fs.open_input_stream(f"{path}.rec", buffer_size=_FLUSH) as f:
        while (data := _next(f, path)) is not None:
            yield parse(data)


def read_records(fs: FileSystem, path: str, which: Iterable[int]) -> Iterator[tuple[int | None, np.ndarray]]:
    """Chosen records, in the order asked for, through the index."""
    index = read_index(fs, path)
    with fs.open_input_file(f"{path}.rec") as f:
        for k in which:
            f.seek(int(index[k]))
            yield parse(_next(f, path))


_SHARD = "shard long, path string, n_records long, n_tokens long"


def _write(root: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, context = word_encoder(tokenizer), TaskContext.get()
        fs, base = FileSystem.from_uri(root)
        # a name of its own for each attempt: only those in the manifest count
        path = f"{base}/part-{context.partitionId():06d}-{context.taskAttemptId()}"
        fs.create_dir(base, recursive=True)
        tokens = 0

        def payloads():
            nonlocal tokens
            for batch in batches:
                for doc_id, text in zip(batch[0].to_pylist(), batch[1].cast(pa.binary()), strict=True):
                    ids = np.append(encoder.ids(text.as_py()), np.array(end_id, encoder.dtype))
                    tokens += len(ids)
                    yield payload(doc_id, ids)

        n = len(write_shard(fs, path, payloads()))
        row = {"shard": [context.partitionId()], "path": [path], "n_records": [n], "n_tokens": [tokens]}
        yield pa.RecordBatch.from_pydict(row)

    return run


def write_records(docs: DataFrame, tokenizer: str, end_id: int, root: str) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write shards below ``root``, in ascending ``doc_id`` order.

    Returns the manifest, one row per shard: ``shard, path, n_records,
    n_tokens``; shards of higher numbers hold higher ids.  ``root`` is a uri on
    storage that all executors share.  Null ids come first; null and empty
    texts are records of the end id alone; ties lie next to one another;
    repeated rows are repeated records; other columns are not read; an empty
    table gives shards without records or none.
    """
    # rows of one id may be dealt to several shards, in an order that their texts give
    tie = F.xxhash64("text")
    ordered = only(docs, "doc_id", "text").repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    return cut_lineage(ordered.mapInArrow(_write(root, tokenizer, end_id), _SHARD))


def _digest(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        schema = pa.schema([(n, pa.int64()) for n in names])
        fs, _ = FileSystem.from_uri(root)
        for batch in batches:
            for shard in batch.to_pylist():
                at, rows = shard["before"], []
                for doc_id, ids in read_shard(fs, shard["path"]):
                    rows.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                    if len(rows) == 20_000:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)
                        rows = []
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)

    return run


def digest_records(manifest: DataFrame, root: str) -> DataFrame:
    """Read every shard back: ``doc_id, start, n_tokens, ids_crc32`` per record.

    Only the manifest, one row per shard, is ordered in one place; the shards
    are dealt out evenly, a few to a task.
    """
    n_shards = max(1, manifest.count())
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.where("n_records > 0").select(F.col("shard"), "path", before.alias("before"))
    # a given number of partitions is kept, where the planner would join the small manifest into one task
    dealt = shards.repartitionByRange(n_shards, "shard").select("path", "before")
    return dealt.mapInArrow(
        _digest(root), "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def record_root(spark) -> str:
    """A new folder for shards in the cluster's shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/records/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
