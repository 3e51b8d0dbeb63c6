"""Exact removal of long repeated strings with run-length indexes (operator 7).

Every window of ``window`` bytes has one content-defined anchor, so equal
windows have equal anchors at equal distances.  The windows that share an
anchor at one place are its *context*, at most some 770 bytes.  Contexts that
are equal as a whole need counting only; contexts of one anchor that differ
go to one run-length index, whose matching statistics tell which windows
start anywhere else.  Contexts of anchors with very many different ones are
cut into parts, whose windows all hold one core; the core is the finer anchor,
and parts are treated like contexts.  Should a core be crowded too, its windows
are counted by hash, which can be summed before the shuffle.

Passages of many words, which may be shorter than the window, have anchors and
contexts of their own and take the same way; see ``passages``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.anchors import anchor_runs, segments
from tidewell.llm.columns import only
from tidewell.llm.passages import passage_marks, passage_runs
from tidewell.llm.runindex import RunIndex
from tidewell.sources.storage import cut_lineage, drop_table

#: Different contexts of one anchor that an index takes; beyond, windows are counted by hash.
MOST_CONTEXTS = 2048
#: Bytes of contexts indexed together.
INDEX_BYTES = 1 << 18
#: Windows of a part of a context of a crowded anchor.
PART_WINDOWS = 23

#: Seed of the digests of passages' contexts; those of windows' contexts are seeded by less than a window.
_PASSAGE = 1 << 32

_ANCHORS = "k1 long, k2 long, start int, size int, lead int, anchor long, c1 long, c2 long, words boolean"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


def _digest(data: bytes, seed: int) -> tuple[int, int]:
    value = xxhash.xxh3_128_intdigest(data, seed)
    return (value >> 64) - (1 << 63), (value & ((1 << 64) - 1)) - (1 << 63)


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds what tells rows apart: ``k1``, the id, and ``k2``, a hash of id and text.

    Rows equal in both have equal texts and get equal spans.
    """
    return docs.select("*", F.coalesce("doc_id", F.lit(0)).alias("k1"), F.xxhash64("doc_id", "text").alias("k2"))


def _find_anchors(window: int, words: int | None):
    """Contexts of the windows, and of the passages if asked for; rows are ``k1, k2, text``."""
    schema = _arrow(_ANCHORS)
    digest = xxhash.xxh3_128_digest

    def names(digests: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)

    def found(columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x).cast(f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch[c].to_numpy(zero_copy_only=False) for c in (0, 1))
            texts = [t.as_py() or b"" for t in batch[2].cast(pa.binary())]
            for data, which, offset, valid in segments(texts, window):
                first, n, place, anchor = anchor_runs(data, valid, window)
                ends, seeds = first + n - 1 + window, place - first
                c = names([digest(data[a:b], s) for a, b, s in zip(first.tolist(), ends.tolist(), seeds.tolist(), strict=True)])
                keys, plain = which[first], np.zeros(len(first), bool)
                yield found((k1[keys], k2[keys], offset[first], n - 1 + window, seeds, anchor.view(np.int64), c[:, 0], c[:, 1], plain))
            for data, begin, end, number, start, anchor in passage_runs(texts, words) if words is not None else ():
                c = names([digest(data[a:b], _PASSAGE) for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
                flat, passage = np.zeros(len(begin), np.int64), np.ones(len(begin), bool)
                yield found((k1[number], k2[number], start, end - begin, flat, anchor.view(np.int64), c[:, 0], c[:, 1], passage))

    return run


_MARKS = "c1 long, c2 long, low int, high int"


def _ranges(marks: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _index_contexts(window: int):
    """Marks of the windows that start twice or more; rows are ``anchor, c1, c2, body``, sorted by anchor."""
    schema = _arrow(_MARKS)

    def marks(contexts: dict[tuple[int, int], bytes]) -> pa.RecordBatch:
        index = RunIndex(list(contexts.values()), max(map(len, contexts.values())))
        repeated = index.repeats(window)
        rows = []
        for (c, body), start in zip(contexts.items(), index.starts.tolist(), strict=True):
            rows += [(*c, *r) for r in _ranges(repeated[start : start + len(body) - window + 1])]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(list(x), f.type) for x, f in zip(columns, schema, strict=True)], schema=schema
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], bytes] = {}
        size, last = 0, None
        for batch in batches:
            for anchor, c1, c2, body in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if size >= INDEX_BYTES and anchor != last:
                    yield marks(held)
                    held, size = {}, 0
                last = anchor
                if (c1, c2) not in held:
                    held[c1, c2] = body
                    size += len(body)
        if held:
            yield marks(held)

    return run


_PARTS = "anchor long, c1 long, c2 long, p1 long, p2 long, low int, body binary"


def _parts(window: int):
    """Parts of contexts; rows are ``anchor, c1, c2, lead, body``, ``lead`` being the anchor's distance from the first window.

    Parts are laid out by the distance of a window's start from the anchor, so
    equal windows lie in parts of the same core.  A part's ``p1, p2`` name its
    context, ``low`` its first window there.
    """
    schema = _arrow(_PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, p1, p2, lead, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = len(body) - window + 1
                for part in range(-lead // PART_WINDOWS, (n - 1 - lead) // PART_WINDOWS + 1):
                    begin = part * PART_WINDOWS + lead  # of a whole part, in windows of the context
                    low, high = max(0, begin), min(n, begin + PART_WINDOWS)
                    core = body[begin + PART_WINDOWS - 1 : begin + window]
                    piece = body[low : high - 1 + window]
                    anchor = xxhash.xxh3_64_intdigest(core, part & 0xFFFF) - (1 << 63)
                    rows.append((anchor, *_digest(piece, low - begin), p1, p2, low, piece))
            columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _window_hashes(window: int):
    """One row per window; rows are ``c1, c2, body``."""
    schema = _arrow("w1 long, w2 long, c1 long, c2 long, low int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = []
                for c1, c2, body in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns), strict=True):
                    rows += [(*_digest(body[i : i + window], 0), c1, c2, i) for i in range(len(body) - window + 1)]
                arrays = [pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def _by_window(bodies: DataFrame, window: int) -> DataFrame:
    """Marks of ``bodies(c1, c2, body)`` by counting the hashes of their windows."""
    hashed = bodies.select("c1", "c2", "body").mapInArrow(
        _window_hashes(window), "w1 long, w2 long, c1 long, c2 long, low int"
    )
    hashed = cut_lineage(hashed)
    twice = hashed.groupBy("w1", "w2").agg(F.count("*").alias("m")).where("m > 1").select("w1", "w2")
    return hashed.join(twice, ["w1", "w2"]).select("c1", "c2", "low", (F.col("low") + 1).alias("high"))


def _by_part(bodies: DataFrame, window: int) -> DataFrame:
    """Marks of ``bodies(anchor, c1, c2, lead, body)`` by those of their parts."""
    parts = bodies.select("anchor", "c1", "c2", "lead", "body").mapInArrow(_parts(window), _PARTS)
    # documents that repeat an id and its text gave the same contexts
    parts = cut_lineage(parts.dropDuplicates(["p1", "p2", "low"]))
    several = parts.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1").select("anchor")
    kinds = parts.join(cut_lineage(several), "anchor").groupBy("anchor", "c1", "c2")
    kinds = cut_lineage(kinds.agg(F.count("*").alias("copies"), F.first("body").alias("body")))
    marks = _marks(kinds, window, _by_window)
    return parts.join(marks, ["c1", "c2"]).select(
        F.col("p1").alias("c1"), F.col("p2").alias("c2"), parts["low"] + marks["low"], parts["low"] + marks["high"]
    )


def _marks(bodies: DataFrame, window: int, beyond) -> DataFrame:
    """``c1, c2, low, high``: the windows of ``bodies(anchor, c1, c2, copies, body)`` that start elsewhere too.

    ``c1, c2`` name bodies, and rows may be repeated; ``beyond`` takes those of crowded anchors.
    """
    whole = bodies.where("copies > 1").select(
        "c1", "c2", F.lit(0).alias("low"), (F.length("body") - (window - 1)).alias("high")
    )
    sizes = cut_lineage(bodies.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1"))
    mixed = bodies.join(sizes, "anchor")
    few = mixed.where(F.col("m") <= MOST_CONTEXTS).select("anchor", "c1", "c2", "body")
    indexed = few.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_index_contexts(window), _MARKS)
    marks = whole.union(indexed)
    if sizes.where(F.col("m") > MOST_CONTEXTS).isEmpty():
        return marks
    return marks.union(beyond(mixed.where(F.col("m") > MOST_CONTEXTS), window))


def _bodies(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """One context of each kind, cut out of a document that holds it: ``anchor, c1, c2, copies, lead, words, body``."""
    contexts = mixed.groupBy("anchor", "c1", "c2").agg(
        F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("k1", "k2", "start", "size", "lead", "words"))
    )
    kinds = F.struct("anchor", "c1", "c2", "copies", "start", "size", "lead", "words")
    asked = contexts.groupBy("k1", "k2").agg(F.collect_list(kinds).alias("asked"))
    data = F.col("text").cast("binary")
    cut = F.transform(
        "asked",
        lambda x: F.struct(
            *(x[c] for c in ("anchor", "c1", "c2", "copies", "lead", "words")),
            F.substring(data, x["start"] + 1, x["size"]).alias("body"),
        ),
    )
    found = docs.join(asked, ["k1", "k2"]).select(F.inline(cut).alias("anchor", "c1", "c2", "copies", "lead", "words", "body"))
    return cut_lineage(found)


def repeated_spans(docs: DataFrame, window: int, words: int | None = None) -> DataFrame:
    """``k1, k2, spans``: the byte ranges covered by repeated windows, for rows that have any; ranges may overlap.

    With ``words``, those of strings of so many words too; their ranges say so in ``words``.
    """
    found = docs.select("k1", "k2", "text").mapInArrow(_find_anchors(window, words), _ANCHORS)
    found = cut_lineage(found)
    differ = (F.min("c1") < F.max("c1")) | (F.min("c2") < F.max("c2"))
    shared = found.groupBy("anchor").agg(F.count("*").alias("m"), differ.alias("mixed")).where("m > 1").drop("m")
    # written first, so that the join can split an anchor that a third of all rows have
    shared = cut_lineage(found.join(cut_lineage(shared), "anchor"))
    drop_table(found)
    plain = shared.where("NOT mixed").select("k1", "k2", "start", (F.col("start") + F.col("size")).alias("end"), "words")
    mixed = shared.where("mixed")
    bodies = _bodies(docs, mixed)
    marks = _marks(bodies.where("NOT words"), window, _by_part).withColumn("high", F.col("high") - 1 + window)
    if words is not None:
        marks = marks.union(passage_marks(bodies.where("words"), words))
    marks = cut_lineage(marks.distinct())
    drop_table(bodies)
    partly = mixed.join(marks, ["c1", "c2"]).select(
        "k1", "k2", F.col("start") + F.col("low"), F.col("start") + F.col("high"), "words"
    )
    return plain.union(partly).groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end", "words")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut_out(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


def _lists(spans: pa.ListArray) -> Iterator[tuple[list[tuple[int, int]], list[tuple[int, int]]]]:
    """Spans of windows and of passages, for each row."""
    offsets = spans.offsets.to_pylist()
    starts, ends, words = (spans.values.field(name).to_pylist() for name in ("start", "end", "words"))
    for low, high in zip(offsets, offsets[1:], strict=False):
        kinds: tuple[list, list] = ([], [])
        for k in range(low, high):
            kinds[words[k]].append((starts[k], ends[k]))
        yield kinds


def _once_each(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One of each kind of equal rows, and those of them that occur again (``k1, k2, text``).

    Counting the keys costs one slim shuffle; only texts that do occur again are moved.
    """
    rows = keyed.select("k1", "k2", "text")
    again = cut_lineage(rows.groupBy("k1", "k2").agg(F.count("*").alias("m")).where("m > 1").select("k1", "k2"))
    copies = rows.join(again, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("text").alias("text"))
    copies = cut_lineage(copies)
    return rows.join(again, ["k1", "k2"], "left_anti").union(copies), copies


def _whole(copies: DataFrame, window: int, words: int | None) -> DataFrame:
    """``k1, k2, spans`` of texts that occur again: they go as a whole, as a passage from the first word to the last."""
    n_bytes = F.octet_length("text")

    def span(start, end, passage):
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(passage).alias("words"))

    spans = [F.when(n_bytes >= window, span(F.lit(0), n_bytes, False))]
    if words is not None:
        blank = F.lit(" \t\n\x0b\f\r")
        start, end = n_bytes - F.octet_length(F.ltrim("text", blank)), F.octet_length(F.rtrim("text", blank))
        n_words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
        spans.append(F.when(n_words >= words, span(start, end, True)))
    return copies.select("k1", "k2", F.array_compact(F.array(*spans)).alias("spans")).where(F.size("spans") > 0)


def _with_spans(docs: DataFrame, window: int, words: int | None = None) -> DataFrame:
    keyed = _keyed(docs)
    once, copies = _once_each(keyed)
    whole = _whole(copies, window, words)
    spans = repeated_spans(once, window, words).join(whole, ["k1", "k2"], "left_anti").union(whole)
    return keyed.join(spans, ["k1", "k2"], "left").drop("k1", "k2")


_DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"
_PASSAGES = ", n_passages long, passage_bytes long, passage_free string"


def digest(docs: DataFrame, window: int = 400, words: int | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, text`` per row of ``docs(doc_id, text)``.

    A byte goes if a string of ``window`` bytes that covers it also starts
    anywhere else, in the same document or another; matches do not cross
    documents and are judged on the input.  Null texts count as empty; texts
    shorter than the window are kept; repeated rows remove each other, however many there are; rows
    with null ids are rows like any other; other columns are not read.  ``text`` is what is left, less the
    rest of characters that were cut in two.

    With ``words``, three columns follow: runs and bytes of the strings of so many words that start anywhere
    else, however short they are, and the text without these and without what ``text`` lacks.
    """
    fields = _DIGEST + ("" if words is None else _PASSAGES)
    schema = _arrow(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            texts = batch[1].cast(pa.binary())
            for doc_id, text, (spans, found) in zip(batch[0].to_pylist(), texts, _lists(batch[2]), strict=True):
                data = text.as_py() or b""
                runs = merged(spans)
                kept = cut_out(data, runs)
                left = kept.decode(errors="ignore")
                row = [doc_id, len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), left]
                if words is not None:
                    passages = merged(found)
                    both = cut_out(data, merged(runs + passages)).decode(errors="ignore") if passages else left
                    row += [len(passages), sum(b - a for a, b in passages), both]
                rows.append(row)
            columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    rows = _with_spans(only(docs, "doc_id", "text"), window, words)
    return rows.select("doc_id", "text", "spans").mapInArrow(run, fields)


def remove_repeats(docs: DataFrame, window: int = 400, words: int | None = None) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text``, and its ``n_chars``; all rows and columns stay.

    With ``words``, strings of so many words that start anywhere else go too, however short they are.
    A character of which some bytes go, goes as a whole.
    """
    names = docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{n}`") for n in names)).alias("row"), "doc_id", "text")
    rows = _with_spans(rows, window, words)

    @F.pandas_udf("string")
    def kept(texts, spans):
        out = []
        for text, found in zip(texts, spans, strict=True):
            if text is not None and found is not None:
                runs = merged([(s["start"], s["end"]) for s in found])
                text = cut_out(text.encode(), runs).decode(errors="ignore")
            out.append(text)
        return type(texts)(out, dtype=object)

    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(kept("text", "spans"))
    rows = rows.select("row", text.alias("kept"))
    changed = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return rows.select(*(changed.get(n, F.col("row")[n]).alias(n) for n in names))
