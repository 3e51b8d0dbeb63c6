"""SimHash near-duplicates through a distributed Gray-order index (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.columns import only
from tidewell.llm.components import components
from tidewell.llm.hamming import linked
from tidewell.sources.storage import cut_lineage

BITS = 64
#: Codes of one group in one task; larger groups are dealt out as pairs of parts.
PART = 4096
_AT_ONCE = 1 << 14


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """SimHash over the word shingles of a text, A-Z lowered; 0 without words."""
    parts = text.lower().split()  # both are ASCII only for bytes: A-Z, and space with tab to carriage return
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) < words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    cuts = zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in cuts], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _AT_ONCE):
        eight = hashes[at : at + _AT_ONCE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(eight, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """``doc_id, code`` (the fingerprint as a signed long) per row of ``docs(doc_id, text)``."""
    schema = pa.schema([("doc_id", pa.int64()), ("code", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [fingerprint(t.as_py() or b"", words) for t in batch[1].cast(pa.binary())]
            code = pa.array(np.array(codes, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch[0].cast(pa.int64()), code], schema=schema)

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, code long")


def _blocks(distance: int) -> list[tuple[int, int]]:
    """``(lowest bit, width)`` of distance + 1 blocks: codes within the distance agree on one at least."""
    cuts = [round(k * BITS / (distance + 1)) for k in range(distance + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _link_groups(distance: int):
    """Star edges of each group's components; rows come sorted by group."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def edges(codes: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if right.any() and not right.all():
            laid = np.concatenate([codes[~right], codes[right]])
            labels = linked(codes[~right], distance, codes[right])
        else:
            laid, labels = codes, linked(codes, distance)
        moved = np.flatnonzero(labels != np.arange(len(laid)))
        return laid[moved], laid[labels[moved]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = None

        def out(rows: np.ndarray) -> pa.RecordBatch:
            bounds = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            found = [edges(g[:, 5].view(np.uint64), g[:, 4] > 0) for g in np.split(rows, bounds) if len(g) > 1]
            a = np.concatenate([x[0] for x in found] or [np.empty(0, np.uint64)]).view(np.int64)
            b = np.concatenate([x[1] for x in found] or [np.empty(0, np.uint64)]).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.int64, copy=False)
            if last is not None:  # the group at the seam may go on
                rows = np.concatenate([last, rows])
            whole = np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(axis=1))
            cut = whole[-1] + 1 if len(whole) else 0
            last = rows[cut:]
            if cut:
                yield out(rows[:cut])
        if last is not None:
            yield out(last)

    return run


def links(codes: DataFrame, distance: int) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of all pairs within ``distance`` among distinct ``codes(code)``.

    Each code goes to distance + 1 groups, one per block of bits, so that a
    close pair meets in one of them.  Groups above PART codes are dealt out in
    parts: one task for each pair of parts, so no task holds more than two.
    A task returns star edges, fewer than it has codes, never all pairs.
    """
    tables = [
        F.struct(
            F.lit(t).cast("long").alias("table"),
            F.shiftrightunsigned("code", low).bitwiseAND((1 << width) - 1).alias("key"),
        )
        for t, (low, width) in enumerate(_blocks(distance))
    ]
    rows = codes.select("code", F.explode(F.array(*tables)).alias("g")).select("code", "g.table", "g.key")
    sizes = rows.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = sizes.select("table", "key", F.ceil(F.col("n") / PART).alias("parts"))
    own = F.pmod(F.xxhash64("code"), F.col("parts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    dealt = rows.join(sizes, ["table", "key"]).withColumn("own", own).select("*", other.alias("other"))
    dealt = dealt.select(
        "table",
        "key",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("long").alias("right"),
        "code",
    )
    group = ["table", "key", "i", "j"]
    dealt = dealt.repartition(*group).sortWithinPartitions(*group)
    return dealt.mapInArrow(_link_groups(distance), "a long, b long").distinct()


def _hex(code: Column) -> Column:
    return F.lower(F.lpad(F.hex(code), 16, "0"))


def near_duplicates(docs: DataFrame, distance: int = 4, words: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per row of ``docs(doc_id, text)``.

    Rows whose fingerprints differ in at most ``distance`` bits are linked;
    ``component_id`` is the smallest ``doc_id`` reachable over links.  Null and
    empty texts have fingerprint zero and are linked like any other.  Null ids
    take part, but a component is named by an id only if one is there; repeated
    rows and ties share a component; other columns are not read.
    """
    rows = cut_lineage(fingerprints(docs, words))
    codes = cut_lineage(rows.groupBy("code").agg(F.min("doc_id").alias("first_id")))
    member = components(links(codes.select("code"), distance))
    rooted = codes.join(member.withColumnRenamed("node", "code"), "code", "left")
    rooted = rooted.select("code", "first_id", F.coalesce("component", "code").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_code = rooted.join(named, "root").select("code", "component_id")
    return rows.join(by_code, "code").select("doc_id", _hex(F.col("code")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, distance: int = 4, words: int = 4) -> DataFrame:
    """The rows of ``docs`` that stand for their component: those with its smallest id.

    Rows without an id cannot be named and stay; of rows that repeat an id
    one stays.
    """
    ids = near_duplicates(docs, distance, words).where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = docs.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
