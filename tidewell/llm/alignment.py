"""Alignment of two tokenizers over the same text, by byte spans (operator 12).

Tokenizer A (byte-level, character offsets) reads a space and the text;
tokenizer B (SentencePiece, spans of its proto) the text, before which it puts
a space itself.  The spans give coarse cuts.  A token whose span is not as
long as the bytes it decodes to shares a character with others, or was split
into bytes: there the ends follow from the decoded bytes.  Offsets at which
tokens of both end cut the text into groups.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.sources.storage import cut_lineage

#: Units a worker remembers, in each of two generations; longer ones are not remembered.
MOST_UNITS, LONGEST = 600_000, 64
#: Units encoded, and characters of texts parted, at once.
_AT_ONCE, _CHARS_AT_ONCE = 2000, 1 << 20
#: Id pairs whose counts go to every worker, in front of the join that serves all others.
MOST_PAIRS = 1 << 20
#: Entries a task holds before it hands its counts on.
_HELD = 1 << 21
_SPACE = "▁"


@dataclass(frozen=True)
class Group:
    """Tokens of A and B that cover the same bytes, ``start`` to ``end``."""

    start: int
    end: int
    a: tuple[int, ...]
    b: tuple[int, ...]


def byte_alphabet() -> dict[str, int]:
    """The byte of each character that byte-level vocabularies write: itself if printable, else shifted past 255."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def refine(data: bytes, spans: list[tuple[int, int]], decoded: list[bytes]) -> list[int] | None:
    """Byte ends of tokens, from their byte spans in ``data`` and the bytes they decode to.

    A span as long as its decoded bytes stands as it is; any other end lies
    that many decoded bytes after the token before.  None if the decoded bytes
    do not make up ``data``.
    """
    ends, at = [], 0
    for (begin, end), part in zip(spans, decoded, strict=True):
        start = at
        at = end if begin == at and end - begin == len(part) else at + len(part)
        if data[start:at] != part or not part:
            return None
        ends.append(at)
    return ends if at == len(data) else None


def _ends(spans: np.ndarray, decoded: list[bytes]) -> np.ndarray:
    """``refine`` for whole columns: where a span is as long as its decoded bytes its end stands."""
    sizes = np.fromiter(map(len, decoded), np.int64, len(decoded))
    ends = np.cumsum(sizes)
    coarse = (spans[:, 1] - spans[:, 0] == sizes) & (spans[:, 0] == ends - sizes)
    return np.where(coarse, spans[:, 1], ends)


class Aligner:
    """Aligns texts unit by unit; a unit is a stretch that no token of either tokenizer crosses.

    A unit begins at a space or line feed after anything but white space, so
    most are a space and a word, and those met before are looked up.
    """

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_file(a_path)
        self._a.encode_special_tokens = True  # their strings in a text are ordinary text
        bytes_of = byte_alphabet()
        self.a_bytes = {i: bytes(bytes_of[c] for c in t) for t, i in self._a.get_vocab(False).items() if set(t) <= bytes_of.keys()}
        self._b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:-1], 16)]) if self._b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)
        ]
        #: B's tokens never reach over the beginning of a unit, if in its pieces a line feed and a space only come first
        inner = [p.lstrip(_SPACE) for i, p in enumerate(pieces) if not self._b.is_byte(i) and len(p) > 1]
        parted = not any("\n" in p or _SPACE in p for p in inner)
        self._units = re.compile(r"(?<=\S)(?=[ \n])") if parted else None
        self._stops = parted and not any(re.search(r"[^\W\d_][.,]", p) for p in inner)
        self._lead = [self._b.piece_to_id(_SPACE), self._b.piece_to_id("<0x0A>")]
        self._shown = [str(i) for i in range(max(len(pieces), max(self.a_bytes) + 1))]
        self._known: dict[str, tuple | None] = {}
        self._before: dict[str, tuple | None] = {}

    def _encode(self, units: list[str]) -> Iterator[tuple[list[int], list[int], list[int], list[int]] | None]:
        """Per unit, ids and byte ends of its tokens, of A and of B; None if either's bytes are not the unit's."""
        # B puts a space before its input: a line feed keeps that apart from the unit
        read = self._b.encode(["\n" + u for u in units], return_type="proto", num_threads=1)
        of_a, of_b, lead = self.a_bytes, self.b_bytes, self._lead
        for unit, proto in zip(units, read, strict=True):
            data = unit.encode()
            found = self._a.encode(unit, add_special_tokens=False)
            a_ids, a_spans = found.ids, found.offsets
            if len(data) > len(unit):
                at = [0, *accumulate(len(c.encode()) for c in unit)]
                a_spans = [(at[s], at[e]) for s, e in a_spans]
            pieces = [(p.id, p.begin - 1, p.end - 1) for p in proto.pieces]
            if [i for i, _, _ in pieces[:2]] != lead:
                yield None
                continue
            b_ids = [i for i, _, _ in pieces[2:]]
            a_ends = refine(data, a_spans, [of_a.get(i, b"") for i in a_ids])
            b_ends = refine(data, [(begin, end) for _, begin, end in pieces[2:]], [of_b[i] for i in b_ids])
            yield None if a_ends is None or b_ends is None else (a_ids, a_ends, b_ids, b_ends)

    @staticmethod
    def _cut(a_ids: list[int], a_ends: list[int], b_ids: list[int], b_ends: list[int]) -> Iterator[tuple[list, list, int]]:
        """``(ids of A, ids of B, end)`` of each group."""
        i = j = at_i = at_j = 0
        while at_i < len(a_ends):
            if a_ends[at_i] < b_ends[at_j]:
                at_i += 1
            elif a_ends[at_i] > b_ends[at_j]:
                at_j += 1
            else:
                at_i, at_j = at_i + 1, at_j + 1
                yield a_ids[i:at_i], b_ids[j:at_j], a_ends[at_i - 1]
                i, j = at_i, at_j

    def _digest(self, found: tuple[list[int], list[int], list[int], list[int]] | None) -> tuple | None:
        """``(tokens of A, of B, groups, their text, the linked ids)`` of an encoded unit."""
        if found is None:
            return None
        texts, links, shown = [], [], self._shown
        for a, b, _ in self._cut(*found):
            texts.append(f"{','.join([shown[i] for i in a])}|{','.join([shown[i] for i in b])}")
            links.append(a[-1] << 32 | b[-1])  # tokens that end together: the last of A and of B in each group
        return len(found[0]), len(found[2]), len(links), ";".join(texts), array("q", links).tobytes()

    def _digests(self, units: list[str]) -> list[tuple | None]:
        """``_digest`` of units, read as one text where they can follow one another in it.

        The spans of both tokenizers are laid against the decoded bytes as whole columns: an
        end that its span and the bytes give alike is a coarse cut, any other follows from the bytes.
        """
        laid = "".join(units)
        if self._units is None or self._units.split(laid) != units:
            return list(map(self._digest, self._encode(units)))
        data = laid.encode()
        found = self._a.encode(laid, add_special_tokens=False)
        pieces = self._b.encode("\n" + laid, return_type="proto").pieces
        spans_b = np.array([(p.id, p.begin, p.end) for p in pieces], np.int64)
        a_ids, b_ids = found.ids, spans_b[2:, 0].tolist()
        decoded_a, decoded_b = [self.a_bytes.get(i, b"") for i in a_ids], [self.b_bytes[i] for i in b_ids]
        sizes = np.frombuffer(laid.encode("utf-32-le"), np.uint32)
        sizes = 1 + (sizes >= 0x80) + (sizes >= 0x800) + (sizes >= 0x10000)
        at = np.concatenate([[0], np.cumsum(sizes)])
        ends_a = _ends(at[np.array(found.offsets, np.int64).reshape(-1, 2)], decoded_a)
        ends_b = _ends(spans_b[2:, 1:] - 1, decoded_b)
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        bounds = np.cumsum([len(u.encode()) for u in units])
        lead = spans_b[:2, 0].tolist() == self._lead
        if not lead or b"".join(decoded_a) != data or b"".join(decoded_b) != data or not np.isin(bounds, common).all():
            return list(map(self._digest, self._encode(units)))
        cuts_a = (np.searchsorted(ends_a, common) + 1).tolist()
        cuts_b = (np.searchsorted(ends_b, common) + 1).tolist()
        of_unit = (np.searchsorted(common, bounds) + 1).tolist()
        links = (np.array(a_ids)[np.array(cuts_a) - 1] << 32) | np.array(b_ids)[np.array(cuts_b) - 1]
        shown_a, shown_b = [self._shown[i] for i in a_ids], [self._shown[i] for i in b_ids]
        texts, i, j = [], 0, 0
        for to_a, to_b in zip(cuts_a, cuts_b, strict=True):
            texts.append(f"{','.join(shown_a[i:to_a])}|{','.join(shown_b[j:to_b])}")
            i, j = to_a, to_b
        out, group, i, j = [], 0, 0, 0
        for last in of_unit:
            to_a, to_b = cuts_a[last - 1], cuts_b[last - 1]
            out.append((to_a - i, to_b - j, last - group, ";".join(texts[group:last]), links[group:last].tobytes()))
            group, i, j = last, to_a, to_b
        return out

    def _learn(self, units: set[str]) -> None:
        """Look up all units that are not known yet; those of the generation before are taken over."""
        if len(self._known) >= MOST_UNITS:
            self._known, self._before = {}, self._known
        known, before = self._known, self._before
        missing = units - known.keys()
        old = missing & before.keys()
        known.update((u, before[u]) for u in old)
        missing -= old
        # both tokenizers part a letter from a stop: such units are two, that are often known already
        joint = {u for u in missing if u[-1] in ".," and u[-2:-1].isalpha()} if self._stops else set()
        parts = {p for u in joint for p in (u[:-1], u[-1])} - known.keys() - missing
        old = parts & before.keys()
        known.update((u, before[u]) for u in old)
        single = [*(missing - joint), *(parts - old)]
        for at in range(0, len(single), _AT_ONCE):
            some = single[at : at + _AT_ONCE]
            known.update(zip(some, self._digests(some), strict=True))
        for unit in joint:
            word, stop = known.get(unit[:-1]), known[unit[-1]]
            if word is None and unit[:-1] not in known:  # "ab.." and the like
                (found,) = self._encode([unit])
                known[unit] = self._digest(found)
                continue
            known[unit] = word and stop and (
                word[0] + stop[0], word[1] + stop[1], word[2] + stop[2], f"{word[3]};{stop[3]}", word[4] + stop[4]
            )

    def _forget(self, units: set[str]) -> None:
        """Back to the bounds of the memory."""
        known = self._known
        for unit in units:
            if len(unit) > LONGEST:
                known.pop(unit, None)
        while len(known) > MOST_UNITS:
            known.popitem()

    def _parts(self, text: str) -> Iterable[str]:
        """The units of a space and a text."""
        if not self._units:
            return (" " + text,)
        if "  " not in text and "\n" not in text:
            words = text.split(" ")
            if words == text.split():  # no white space but single spaces between words
                return [" " + w for w in words]
        return self._units.split(" " + text)

    def groups(self, text: str | None) -> list[Group]:
        """Groups over the bytes of a space and the text; none for null, empty and unlike texts."""
        out: list[Group] = []
        before = 0
        for found in self._encode(list(self._parts(text))) if text else ():
            if found is None:
                return []
            start = before
            for a, b, end in self._cut(*found):
                out.append(Group(start, before + end, tuple(a), tuple(b)))
                start = before + end
            before = start
        return out

    def summary(self, text: str | None) -> tuple[int, int, int, str, np.ndarray]:
        return next(self.summaries([text]))

    def summaries(self, texts: Iterable[str | None]) -> Iterator[tuple[int, int, int, str, np.ndarray]]:
        """Per text ``n_a, n_b, n_groups, groups as text, links``; zeros and nothing for null, empty and unlike texts."""
        some, size = [], 0
        for text in texts:
            some.append(text)
            size += len(text or "")
            if size >= _CHARS_AT_ONCE:
                yield from self._summaries(some)
                some, size = [], 0
        yield from self._summaries(some)

    def _summaries(self, texts: list[str | None]) -> list[tuple[int, int, int, str, np.ndarray]]:
        none = 0, 0, 0, "", np.empty(0, np.int64)
        parted = [[u for line in self._lines(t) for u in line] if t else [] for t in texts]
        units = set().union(*parted)
        self._learn(units)
        known, out = self._known, []
        for own in parted:
            found = [known[u] for u in own]
            if not found or None in found:
                out.append(none)
                continue
            n_a, n_b, n_groups, shown, links = zip(*found, strict=True)
            links = np.frombuffer(b"".join(links), np.int64)
            out.append((sum(n_a), sum(n_b), sum(n_groups), ";".join(shown), links))
        self._forget(units)
        return out

    def _lines(self, text: str) -> Iterator[Iterable[str]]:
        """The units of a space and a text, line by line where each line is words between single spaces."""
        lines = text.split("\n")
        words = [line.split(" ") for line in lines]
        if not self._units or any(w != line.split() for w, line in zip(words, lines, strict=True)):
            yield self._parts(text)
            return
        for k, (first, *rest) in enumerate(words):
            yield [("\n" if k else " ") + first, *(" " + w for w in rest)]


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner per worker process and pair of files."""
    return Aligner(a_path, b_path)


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``doc_id, start, end, a_ids, b_ids`` per group of ``docs(doc_id, text)``, over the bytes of a space and the text.

    Null and empty texts, and those that either tokenizer does not give back
    byte for byte, have no groups; texts of any length are read whole; repeated
    rows are aligned each; other columns are not read.
    """
    names = ["doc_id", "start", "end", "a_ids", "b_ids"]
    ids = pa.list_(pa.int32())
    kinds = [pa.int64(), pa.int64(), pa.int64(), ids, ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = aligner(a_path, b_path)
        for batch in batches:
            for doc_id, text in zip(batch[0].to_pylist(), batch[1], strict=True):
                groups = of.groups(text.as_py())
                for at in range(0, len(groups), 10_000):
                    part = groups[at : at + 10_000]
                    columns = [[doc_id] * len(part), *([getattr(g, n) for g in part] for n in ("start", "end", "a", "b"))]
                    arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, start long, end long, a_ids array<int>, b_ids array<int>")


_DOC = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
_DOC_SCHEMA = pa.schema(
    [(n, pa.int64()) for n in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links")]
    + [("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())]
)


def _documents(a_path: str, b_path: str):
    """Per document: counts, hash of the groups, and its distinct linked pairs with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, row = aligner(a_path, b_path), TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = []
            for doc_id, found in zip(batch[0].to_pylist(), of.summaries(t.as_py() for t in batch[1]), strict=True):
                n_a, n_b, n_groups, groups, links = found
                pairs, times = np.unique(links, return_counts=True)
                sha = hashlib.sha256(groups.encode()).hexdigest() if n_groups else ""
                rows.append((row, doc_id, n_a, n_b, n_groups, len(links), sha, pairs.tobytes(), times.astype("<u4").tobytes()))
                row += 1
            columns = list(zip(*rows, strict=True)) or [()] * len(_DOC_SCHEMA)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, _DOC_SCHEMA, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=_DOC_SCHEMA)

    return run


def _links_of(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, numbers and places in the batch of all documents; ``at`` is the column of pairs."""
    pairs = [p.as_buffer() for p in batch[at]]
    times = [t.as_buffer() for t in batch[at + 1]]
    owner = np.repeat(np.arange(len(pairs)), [len(p) // 8 for p in pairs])
    joined = np.frombuffer(b"".join(pairs), np.int64), np.frombuffer(b"".join(times), "<u4").astype(np.int64)
    return *joined, owner


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of a task, handed on whenever it holds too many pairs."""
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    names = ["pair", "n"]
    for batch in batches:
        pairs, times, _ = _links_of(batch, 0)
        keys, place = np.unique(np.concatenate([keys, pairs]), return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, place, np.concatenate([counts, times]))
        counts = total
        if len(keys) > _HELD:
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names)
            keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names)


def pair_counts(documents: DataFrame) -> DataFrame:
    """``pair, n, best``: links per pair of ids in the corpus, and whether no pair of its B id has more."""
    counted = documents.select("pairs", "times").mapInArrow(_count_pairs, "pair long, n long")
    total = cut_lineage(counted.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)))
    top = total.groupBy("b").agg(F.max("n").alias("top"))
    return cut_lineage(total.join(top, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best")))


def _commonest(counts: DataFrame, most: int) -> DataFrame:
    """The pairs with at least so many links, a power of two, that no more than ``most`` remain."""
    power = F.floor(F.log2("n"))
    left, least = 0, 1
    for r in counts.groupBy(power.alias("power")).count().orderBy(F.desc("power")).collect():  # at most 63 rows
        left += r["count"]
        if left > most:
            least = 1 << (r.power + 1)
            break
    return counts.where(F.col("n") >= least)


def _look_up(shared, rest: bool):
    """Sums over the pairs that every worker knows, or the pairs it does not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = shared.value
        for batch in batches:
            pairs, times, owner = _links_of(batch, 1)
            at = np.searchsorted(known, pairs)
            at[at == len(known)] = 0
            found = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            row = batch[0].to_numpy(zero_copy_only=False)
            if rest:
                lost = ~found
                columns = [pa.array(row[owner[lost]]), pa.array(pairs[lost]), pa.array(times[lost])]
                yield pa.RecordBatch.from_arrays(columns, ["row", "pair", "times"])
                continue
            here, where = at[found], owner[found]
            sums = np.zeros((2, len(row)), np.int64)
            np.add.at(sums[0], where, times[found] * best[here])
            np.add.at(sums[1], where, times[found] * n[here])
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(sums[0]), pa.array(sums[1])], ["row", "n_best", "count_sum"])

    return run


def link_table(docs: DataFrame, a_path: str, b_path: str, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` per row of ``docs(doc_id, text)``.

    A link joins two tokens that end together; an id pair's count is its links
    in the whole corpus; ``n_best`` counts links whose pair has its B id's
    highest count.  Texts are tokenized once.  Counts of the ``most_pairs``
    commonest pairs go to every worker, all others are met by a join, so that
    bound changes no result.  Texts without groups (see ``align``) have zeros
    and an empty hash; no rows give none.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    documents = cut_lineage(rows.mapInArrow(_documents(a_path, b_path), _DOC))
    counts = pair_counts(documents)
    top = _commonest(counts, most_pairs).toArrow().sort_by("pair")
    known = [top["pair"].to_numpy(), top["n"].to_numpy(), top["best"].to_numpy(zero_copy_only=False)]
    shared = documents.sparkSession.sparkContext.broadcast(known)
    links = documents.select("row", "pairs", "times")
    sums = links.mapInArrow(_look_up(shared, False), "row long, n_best long, count_sum long")
    others = links.mapInArrow(_look_up(shared, True), "row long, pair long, times long").join(counts, "pair")
    others = others.select(
        "row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum")
    )
    summed = sums.unionByName(others).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return documents.join(summed, "row").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
