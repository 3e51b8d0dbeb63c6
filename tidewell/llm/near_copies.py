"""Near copies at a similarity of five-word shingles, found by SimHash and the Gray-order index, then verified.

Pairs of that similarity differ in too many bits of a fingerprint of shingles
to be searched for by it alone.  A fingerprint of the words, each weighed by the root of
its count, moves far less under a few edits; unrelated texts that it brings together
are told apart by the fingerprint of shingles, before any text is moved.
What both fingerprints link is compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.components import components
from tidewell.llm.hamming import linked
from tidewell.llm.simhash import BITS, PART, fingerprint
from tidewell.sources.storage import cut_lineage

#: Bits in which the fingerprints of words, and of shingles, of near copies may differ.
WORD_BITS, SHINGLE_BITS = 7, 16
#: Texts, and their bytes, of a group that one task compares by itself.
SMALL_TEXTS, SMALL_BYTES = 2000, 32 << 20
#: First texts of a larger group, and their bytes, that the others are held against in one round.  Spark limits ranks
#: inside map tasks up to 1,000 only.
LEADERS, LEADER_BYTES = 1000, 8 << 20
#: Texts compared at once, and shingles at most that many texts hold and that are counted by products of matrices.
_ROWS, _COLUMNS = 256, 4096
_SEED = 42


def word_fingerprint(words: list[bytes]) -> int:
    """SimHash over the distinct words, weighed by the root of how often they occur; 0 without words."""
    if not words:
        return 0
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, _SEED) for w in words), np.uint64, len(words))
    distinct, counts = np.unique(hashes, return_counts=True)
    weights = np.sqrt(counts)
    bits = np.unpackbits(distinct.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = weights @ bits
    return int.from_bytes(np.packbits(2 * ones > weights.sum(), bitorder="little").tobytes(), "little")


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()  # ASCII only for bytes


def shingles(text: str | None, words: int) -> set[bytes]:
    """The distinct shingles of a text; fewer words than that are one shingle, no words are none."""
    parts = _words((text or "").encode())
    if len(parts) < words:
        return {b" ".join(parts)} - {b""}
    return {b" ".join(parts[k : k + words]) for k in range(len(parts) - words + 1)}


def similarity(a: set[bytes], b: set[bytes]) -> float:
    """Jaccard; two texts without words are the same."""
    return len(a & b) / len(a | b) if a or b else 1.0


_CODES = "k1 long, k2 long, t1 long, t2 long, code long, shade long"


def _codes(words: int):
    schema = pa.schema([(f.split()[0], pa.int64()) for f in _CODES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch[2].cast(pa.binary()):
                parts = _words(text.as_py() or b"")
                laid = b" ".join(parts)
                same = xxhash.xxh3_128_intdigest(laid, _SEED)
                rows.append((same >> 64, same & (2**64 - 1), word_fingerprint(parts), fingerprint(laid, words)))
            found = np.array(rows, np.uint64).reshape(-1, 4).view(np.int64)
            arrays = [batch[0], batch[1], *(pa.array(found[:, i]) for i in range(4))]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def _tables(distance: int, n: int) -> list[list[tuple[int, int]]]:
    """Sets of blocks of bits: codes within the distance agree on all blocks of one set at least.

    With more codes, keys take more blocks, so that groups stay small; what is found is the same.
    """
    agreeing = 1 + (n > 1 << 20) + (n > 1 << 27)
    blocks = distance + agreeing
    cuts = [round(k * BITS / blocks) for k in range(blocks + 1)]
    spans = [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [list(chosen) for chosen in combinations(spans, agreeing)]


def _key(chosen: list[tuple[int, int]]) -> Column:
    key, width = F.lit(0).cast("long"), 0
    for low, size in chosen:
        part = F.shiftrightunsigned("code", low).bitwiseAND((1 << size) - 1)
        key, width = key + F.shiftleft(part, width), width + size
    return key


def _link_groups(distance: int, shade_distance: int):
    """Star edges of each group's components; rows ``table, key, i, j, right, code, shade`` come sorted by group."""
    schema = pa.schema([(n, pa.int64()) for n in ("a", "sa", "b", "sb")])

    def edges(group: np.ndarray) -> np.ndarray:
        right, codes, shades = group[:, 4] > 0, group[:, 5].view(np.uint64), group[:, 6].view(np.uint64)
        order = np.argsort(right, kind="stable")
        two = right.any() and not right.all()
        first = order[: len(order) - int(right.sum())] if two else order
        second = order[len(first) :] if two else None
        shade = (shade_distance, shades[first], None if second is None else shades[second])
        labels = linked(codes[first], distance, None if second is None else codes[second], shade)
        moved = np.flatnonzero(labels != np.arange(len(order)))
        ends = order[moved], order[labels[moved]]
        return np.column_stack([x[e] for e in ends for x in (group[:, 5], group[:, 6])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None

        def out(rows: np.ndarray) -> pa.RecordBatch:
            bounds = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            found = [edges(g) for g in np.split(rows, bounds) if len(g) > 1]
            laid = np.concatenate([*found, np.empty((0, 4), np.int64)])
            return pa.RecordBatch.from_arrays([pa.array(laid[:, i]) for i in range(4)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.int64, copy=False)
            rows = rows if last is None else np.concatenate([last, rows])
            whole = np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(axis=1))
            cut = whole[-1] + 1 if len(whole) else 0
            last = rows[cut:]
            if cut:
                yield out(rows[:cut])
        if last is not None:
            yield out(last)

    return run


def _node(code: str, shade: str) -> Column:
    return F.concat(*(F.lpad(F.hex(c), 16, "0") for c in (code, shade)))


def links(codes: DataFrame, distance: int = WORD_BITS, shade_distance: int = SHINGLE_BITS) -> DataFrame:
    """Edges ``(a, b)`` between nodes, named by both codes, of distinct ``codes(code, shade)``.

    Their components are those of all pairs within ``distance`` by code and
    ``shade_distance`` by shade.  Large groups are dealt out as pairs of parts of PART codes.
    """
    tables = [
        F.struct(F.lit(t).cast("long").alias("table"), _key(chosen).alias("key"))
        for t, chosen in enumerate(_tables(distance, codes.count()))
    ]
    rows = codes.select("code", "shade", F.explode(F.array(*tables)).alias("g")).select("code", "shade", "g.table", "g.key")
    sizes = rows.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = sizes.select("table", "key", F.ceil(F.col("n") / PART).alias("parts"))
    own = F.pmod(F.xxhash64("code", "shade"), F.col("parts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    dealt = rows.join(sizes, ["table", "key"]).withColumn("own", own).select("*", other.alias("other"))
    right = (F.col("own") > F.col("other")).cast("long").alias("right")
    group = ["table", "key", "i", "j"]
    dealt = dealt.select("table", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), right, "code", "shade")
    dealt = dealt.repartition(*group).sortWithinPartitions(*group)
    found = dealt.mapInArrow(_link_groups(distance, shade_distance), "a long, sa long, b long, sb long")
    return found.select(_node("a", "sa").alias("a"), _node("b", "sb").alias("b")).distinct()


def _numbered(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """``(text, shingle)`` for the distinct shingles of each text, sorted; equal shingles have one number."""
    numbers: dict[bytes, int] = {}
    spelled = []
    for text in texts:
        ids = [numbers.setdefault(w, len(numbers) + 1) for w in _words((text or "").encode())]
        spelled.append(np.array(ids + [0] * (words - len(ids)) if ids else ids, np.int64))  # zeros end a short text's one shingle
    lengths = np.array([len(x) for x in spelled], np.int64)
    flat = np.concatenate([*spelled, np.zeros(words, np.int64)])
    shingle = flat[: len(flat) - words]
    for k in range(1, words):
        shingle = np.unique(shingle * (len(numbers) + 1) + flat[k : len(flat) - words + k], return_inverse=True)[1]
    owner = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    inside = place + words <= lengths[owner]
    many = int(shingle.max(initial=0)) + 1
    return np.divmod(np.unique(owner[inside] * many + shingle[inside]), many)


class _Shared:
    """How many shingles texts share.  Frequent ones are counted by products of matrices, the others by who holds them."""

    def __init__(self, texts: list[str | None], words: int):
        owner, shingle = _numbered(texts, words)
        n = len(texts)
        held = np.bincount(shingle, minlength=1)
        often = np.flatnonzero(held > max(1, n // 32))
        often = often[np.argsort(-held[often], kind="stable")][:_COLUMNS]
        column = np.full(len(held), -1)
        column[often] = np.arange(len(often))
        frequent, rare = column[shingle] >= 0, (column[shingle] < 0) & (held[shingle] > 1)
        self.sizes = np.bincount(owner, minlength=n)
        self.table = np.zeros((n, len(often)), np.float32)  # counts below 2^24 are exact
        self.table[owner[frequent], column[shingle[frequent]]] = 1
        owner, self.rare = owner[rare], shingle[rare]
        self.starts = np.searchsorted(owner, np.arange(n + 1))
        self.holders = owner[np.argsort(self.rare, kind="stable")]
        self.bounds = np.concatenate([[0], np.cumsum(np.bincount(self.rare, minlength=len(held)))])

    def rarely(self, k: int) -> np.ndarray:
        """Rare shingles of text ``k`` that each text holds."""
        mine = self.rare[self.starts[k] : self.starts[k + 1]]
        lows, counts = self.bounds[mine], self.bounds[mine + 1] - self.bounds[mine]
        at = np.repeat(lows - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        return np.bincount(self.holders[at], minlength=len(self.sizes))

    def near(self, k: int, others: np.ndarray, frequent: np.ndarray, rarely: np.ndarray, least: float) -> bool:
        both = frequent + rarely[others]
        return bool((both >= least * (self.sizes[k] + self.sizes[others] - both)).any())


def _late(texts: list[str | None], words: int, least: float, leaders: int = 0) -> np.ndarray:
    """Whether each text is near an earlier one that stays; given ``leaders``, the first so many stay and only they count."""
    shared, gone = _Shared(texts, words), np.zeros(len(texts), bool)
    for low in range(leaders, len(texts), _ROWS):
        rows = shared.table[low : low + _ROWS]
        before = np.flatnonzero(~gone[: leaders or low])
        met = rows @ shared.table[before].T
        beside = None if leaders else rows @ rows.T
        for k in range(low, low + len(rows)):
            rarely = shared.rarely(k)
            gone[k] = shared.near(k, before, met[k - low], rarely, least)
            if beside is not None and not gone[k]:
                staying = np.flatnonzero(~gone[low:k])
                gone[k] = shared.near(k, low + staying, beside[k - low, staying], rarely, least)
    return gone


def _named(table: pa.Table, gone: np.ndarray) -> pa.Table:
    return table.select(["t1", "t2"]).filter(pa.array(gone))


def _near_within(words: int, least: float):
    """``t1, t2`` of the texts of one small component that are near an earlier text that stays."""

    def run(table: pa.Table) -> pa.Table:
        keys = table.select(["unnamed", "doc_id", "k1", "k2"]).to_pylist()
        order = sorted(range(len(keys)), key=lambda i: (keys[i]["unnamed"], keys[i]["doc_id"] or 0, keys[i]["k1"], keys[i]["k2"]))
        table = table.take(order)
        return _named(table, _late(table["text"].to_pylist(), words, least))

    return run


def _near_leaders(words: int, least: float):
    """``t1, t2`` of one part's texts that are near a leader; all leaders stay."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("leads", "descending")])
        leaders = int(np.sum(table["leads"].to_numpy()))
        return _named(table, _late(table["text"].to_pylist(), words, least, leaders) if leaders else np.zeros(len(table), bool))

    return run


def _copies(candidates: DataFrame, words: int, least: float) -> DataFrame:
    """``t1, t2`` of the texts to drop among ``candidates(component, t1, t2, place, text)``.

    In the order of their places a text goes if it is near an earlier one that
    stays.  Small components are compared in one task each.  Of larger ones the first
    texts lead: one task finds those that stay, the rest is dealt out in parts and held against them, and what
    is near none is a smaller component for the next round.
    """
    dropped = []
    left = cut_lineage(candidates)
    pair = ["t1", "t2"]
    near = lambda texts: cut_lineage(
        texts.select("component", "t1", "t2", "place.*", "text").groupBy("component").applyInArrow(_near_within(words, least), "t1 long, t2 long")
    )
    length = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    while True:
        sizes = cut_lineage(left.groupBy("component").agg(F.count("*").alias("m"), F.sum(length).alias("bytes")).where("m > 1"))
        small = (F.col("m") <= SMALL_TEXTS) & (F.col("bytes") <= SMALL_BYTES)
        dropped.append(near(left.join(sizes.where(small), "component", "left_semi")))
        large = sizes.where(~small)
        if large.isEmpty():
            return reduce(DataFrame.union, dropped)
        left = cut_lineage(left.join(large, "component", "left_semi"))
        # ranks are limited inside each map task, so no more than so many of a component move
        rank = F.row_number().over(Window.partitionBy("component").orderBy("place"))
        ranked = left.select("component", "place", "t1", "t2", length.alias("bytes")).withColumn("rank", rank).where(F.col("rank") <= LEADERS)
        ahead = F.sum("bytes").over(Window.partitionBy("component").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
        chosen = ranked.withColumn("ahead", F.coalesce(ahead, F.lit(0))).where(F.col("ahead") < LEADER_BYTES)
        first = cut_lineage(left.join(chosen.select(*pair), pair, "left_semi"))
        dropped.append(near(first))
        others = left.join(first.select(*pair), pair, "left_anti")
        parts = F.ceil(F.greatest(F.col("m") / SMALL_TEXTS, F.col("bytes") / LEADER_BYTES)).cast("long")
        parted = large.select("component", parts.alias("parts"))
        part = F.pmod(F.xxhash64(*pair), F.col("parts"))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
        leading = first.join(dropped[-1], pair, "left_anti").join(parted, "component").select("component", every.alias("part"), F.lit(True).alias("leads"), *pair, "text")
        dealt = others.join(parted, "component").select("component", part.alias("part"), F.lit(False).alias("leads"), *pair, "text").union(leading)
        dropped.append(cut_lineage(dealt.groupBy("component", "part").applyInArrow(_near_leaders(words, least), "t1 long, t2 long")))
        left = cut_lineage(others.join(dropped[-1], pair, "left_anti"))


def keep_one(docs: DataFrame, least: float = 0.8, words: int = 5) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)`` that stand for their texts, without near copies of texts that stay.

    Texts with the same words, A-Z lowered, are one text; of its rows that of
    the smallest id stays (null ids last).  A text goes if a text that stays shares ``least`` of their distinct
    ``words``-word shingles and both fingerprints link them.  Null and empty texts are one text without
    words; rows that repeat an id with another text are told apart; equal rows leave one; all columns stay; an empty table stays empty.
    """
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    keyed = keyed.select("row", F.xxhash64("row.doc_id").alias("k1"), F.xxhash64("row.doc_id", "row.text").alias("k2"))
    rows = keyed.select("k1", "k2", "row.text").mapInArrow(_codes(words), _CODES)
    ids = keyed.select("k1", "k2", F.col("row.doc_id").alias("doc_id")).distinct()
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("k1"), F.col("k2"))
    placed = cut_lineage(rows.join(ids, ["k1", "k2"]).select("t1", "t2", "code", "shade", place.alias("place")))
    texts = placed.groupBy("t1", "t2").agg(F.min("place").alias("place"), F.first("code").alias("code"), F.first("shade").alias("shade"))
    texts = cut_lineage(texts)
    member = components(links(texts.select("code", "shade").distinct())).withColumnRenamed("node", "own")
    grouped = texts.withColumn("own", _node("code", "shade")).join(member, "own", "left")
    grouped = cut_lineage(grouped.select("t1", "t2", "place", F.coalesce("component", "own").alias("component")))
    several = grouped.groupBy("component").agg(F.count("*").alias("m")).where("m > 1").select("component")
    asked = grouped.join(several, "component", "left_semi").select("component", "t1", "t2", "place", "place.k1", "place.k2")
    with_text = keyed.select("k1", "k2", "row.text").join(asked, ["k1", "k2"]).dropDuplicates(["t1", "t2"])
    gone = _copies(with_text.select("component", "t1", "t2", "place", "text"), words, least)
    stay = cut_lineage(texts.join(gone, ["t1", "t2"], "left_anti").select("place.k1", "place.k2"))
    found = keyed.join(stay, ["k1", "k2"], "left_semi")
    again = cut_lineage(found.groupBy("k1", "k2").agg(F.count("*").alias("m")).where("m > 1").select("k1", "k2"))
    once = found.join(again, ["k1", "k2"], "left_anti").select("row")
    equal = found.join(again, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("row").alias("row")).select("row")
    return once.union(equal).select("row.*")
