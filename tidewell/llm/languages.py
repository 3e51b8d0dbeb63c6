"""Language identification by n-gram filters that answer with a set of languages (operator 11).

A bit-sliced Bloom filter is a table of slots; bit ``l`` of a slot belongs to
language ``l``.  The slots that an n-gram hashes to, joined by *and*, are the
set of all languages that hold the n-gram: one look-up serves every language.
A text is given to the language that holds most of its n-grams, after the
share of n-grams that each filter would hold by chance is taken off.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.columns import only
from tidewell.sources.storage import cut_lineage

#: Lengths of the n-grams, two or more; they run over words in lower case with a blank on either side.
SIZES = (3, 4)
#: A language holds an n-gram that makes up this share of all its n-grams (so at most 1 / LEAST_RATE of them) ...
LEAST_RATE = 1e-5
#: ... and this share of the rate it has in the language where it is commonest, so that stray text teaches nothing.
LEAST_SHARE = 0.1
HASHES = 3
#: Hashes are cut from 21 bits each of an n-gram's 63 lowest bits.
_HASH_BITS = 21
_SLOTS_A_GRAM = 8
MOST_LANGUAGES = 256
UNDETERMINED = "und"
_BLANK = np.uint64(32)
#: N-grams handled at once, and entries a task holds before it hands them on.
_WINDOW, _HELD = 1 << 20, 1 << 21


@cache
def _alphabet() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: whether it is a letter, whether it belongs to a word (letters, marks), its lower case."""
    every = range(0x110000)
    kinds = [unicodedata.category(chr(c))[0] for c in every]
    letter = np.array([k == "L" for k in kinds])
    lower = np.array([ord(chr(c).lower()[0]) if k == "L" else c for c, k in zip(every, kinds, strict=True)], np.uint32)
    return letter, letter | np.array([k == "M" for k in kinds]), lower


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def n_grams(texts: list[str], sizes: tuple[int, ...] = SIZES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The hashed n-grams of some texts, repeats included, with the place of the text each is from."""
    if not texts:
        return
    _, wordly, lower = _alphabet()
    codes = np.frombuffer(f" {' '.join(texts)} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in texts])
    owner = np.append(owner[:1], owner)  # the blank in front
    codes = np.where(wordly[codes], lower[codes], np.uint32(32))
    blank = codes == 32
    kept = np.append(True, ~(blank[1:] & blank[:-1]))
    codes, owner, blank = codes[kept], owner[kept], blank[kept]
    for begin in range(0, len(codes), _WINDOW):
        for size in sizes:
            n = min(_WINDOW, len(codes) - begin - size + 1)
            if n <= 0:
                continue
            hashed = np.full(n, size, np.uint64)
            bridging = np.zeros(n, bool)
            for k in range(size):
                hashed *= np.uint64(0x100000001B3)
                hashed += codes[begin + k : begin + k + n]
                if 0 < k < size - 1:
                    bridging |= blank[begin + k : begin + k + n]
            whole = ~bridging
            yield _mixed(hashed[whole]), owner[begin + 1 : begin + 1 + n][whole]


def _fold(counted: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(np.concatenate([k for k, _ in counted]), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, place, np.concatenate([n for _, n in counted]))
    return keys, total


def _count(sizes: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def hand_on() -> Iterator[pa.RecordBatch]:
            for lang, counted in held.items():
                keys, total = _fold(counted)
                columns = [pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(total)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            langs, texts = batch[0].to_pylist(), batch[1].to_pylist()
            for lang in sorted(set(langs)):
                of_lang = [t for name, t in zip(langs, texts, strict=True) if name == lang]
                counted = held.setdefault(lang, [])
                for grams, _ in n_grams(of_lang, sizes):
                    counted.append(np.unique(grams, return_counts=True))
                    if sum(len(k) for k, _ in counted) > _HELD:
                        counted[:] = [_fold(counted)]
            if sum(len(k) for counted in held.values() for k, _ in counted) > _HELD:
                yield from hand_on()
        yield from hand_on()

    return run


@dataclass
class LanguageFilters:
    """``slots[w, s]``: bits of the languages ``64 w`` to ``64 w + 63`` in slot ``s``."""

    langs: list[str]
    slots: np.ndarray
    sizes: tuple[int, ...] = SIZES

    @property
    def chance(self) -> np.ndarray:
        """Per language: the share of unknown n-grams that its filter holds by accident."""
        set_bits = [int(((self.slots[i >> 6] >> np.uint64(i & 63)) & np.uint64(1)).sum()) for i in range(len(self.langs))]
        return (np.array(set_bits, float) / max(self.slots.shape[1], 1)) ** HASHES

    def holders(self, grams: np.ndarray) -> np.ndarray:
        """Per n-gram, a row of words whose bits tell all languages that hold it."""
        top = np.uint64(self.slots.shape[1] - 1)
        found = self.slots[:, (grams & top).astype(np.int64)]
        for k in range(1, HASHES):
            found &= self.slots[:, ((grams >> np.uint64(_HASH_BITS * k)) & top).astype(np.int64)]
        return found

    def languages_of(self, word: str) -> list[list[str]]:
        """The languages of each n-gram of a word, shorter n-grams first."""
        out = []
        for grams, _ in n_grams([word], self.sizes):
            found = self.holders(grams)
            out += [
                [lang for i, lang in enumerate(self.langs) if int(found[i >> 6, g]) >> (i & 63) & 1] for g in range(len(grams))
            ]
        return out

    def shares(self, texts: list[str]) -> np.ndarray:
        """Per text and language, the share of the text's n-grams that the language holds, less chance; at least 0."""
        hits, total = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        for grams, owner in n_grams(texts, self.sizes):
            found = self.holders(grams)
            total += np.bincount(owner, minlength=len(texts))
            for i in range(len(self.langs)):
                bit = (found[i >> 6] >> np.uint64(i & 63)) & np.uint64(1)
                hits[:, i] += np.bincount(owner, weights=bit, minlength=len(texts))
        chance = self.chance
        return np.clip((hits / np.maximum(total, 1)[:, None] - chance) / np.maximum(1 - chance, 1e-9), 0, 1)

    def decide(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and its share per text; of equal shares the language that was learnt from more wins."""
        letter, _, _ = _alphabet()
        # every letter is part of an n-gram, so only texts without any are left out
        some = [bool(t) and bool(letter[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)].any()) for t in texts]
        if not self.langs or not any(some):
            return [(UNDETERMINED, 0.0)] * len(texts)
        shares = self.shares([t or "" for t in texts])
        best = shares.argmax(axis=1)
        return [
            (self.langs[b], float(row[b])) if known else (UNDETERMINED, 0.0)
            for known, b, row in zip(some, best, shares, strict=True)
        ]


def learn(
    docs: DataFrame, sizes: tuple[int, ...] = SIZES, least_rate: float = LEAST_RATE, least_share: float = LEAST_SHARE
) -> LanguageFilters:
    """Filters from all rows of ``docs(text, lang)`` with a language.

    N-grams are counted by Spark, by language.  A language holds those that
    make up ``least_rate`` of all its n-grams, at most ``1 / least_rate`` of
    them whatever the corpus, and that are at least ``least_share`` as common
    as in any other language; so the filters, which go to every worker, stay
    below ``16 / least_rate`` slots of eight bytes per 64 languages.
    Rows without text or language teach nothing; repeated rows count as often as they
    occur; no rows give filters without a language.  More than
    MOST_LANGUAGES languages are refused, as are column names that are missing.
    """
    known = docs.select(F.col("lang").cast("string"), "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counted = known.mapInArrow(_count(sizes), "lang string, gram long, n long")
    counts = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = cut_lineage(counts)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    named = totals.orderBy(F.desc("total"), "lang").limit(MOST_LANGUAGES + 1).collect()
    if len(named) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    langs = [r.lang for r in named]
    if not langs:
        return LanguageFilters([], np.zeros((1, 1), np.uint64), sizes)
    numbers = counts.sparkSession.createDataFrame(
        [(r.lang, i, r.total) for i, r in enumerate(named)], "lang string, number int, total long"
    )
    rated = counts.join(F.broadcast(numbers), "lang").withColumn("rate", F.col("n") / F.col("total"))
    rated = rated.where(F.col("rate") >= least_rate)
    best = F.max("rate").over(Window.partitionBy("gram"))
    kept = rated.withColumn("best", best).where(F.col("rate") >= F.col("best") * least_share).select("gram", "number")
    kept = cut_lineage(kept)
    largest = kept.groupBy("number").count().agg(F.max("count")).first()[0] or 1
    n_slots = 1 << (_SLOTS_A_GRAM * largest - 1).bit_length()
    if n_slots > 1 << _HASH_BITS:
        raise ValueError("least_rate is too small for the hashes of the filters")
    return LanguageFilters(langs, _slots(kept, n_slots, len(langs)), sizes)


def _slots(kept: DataFrame, n_slots: int, n_langs: int) -> np.ndarray:
    """Set bits of ``kept(gram, number)``: joined per slot by Spark, one row for each slot in use."""
    bits = kept.select(
        F.explode(F.array(*(_slot(F.col("gram"), k, n_slots) for k in range(HASHES)))).alias("slot"),
        F.floor(F.col("number") / 64).alias("word"),
        F.expr("shiftleft(1L, number % 64)").alias("bit"),
    )
    used = bits.groupBy("word", "slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    slots = np.zeros(((n_langs + 63) // 64, n_slots), np.uint64)
    at = used["word"].to_numpy(), used["slot"].to_numpy()
    slots[at] = used["bits"].to_numpy().view(np.uint64)
    return slots


def _slot(gram: Column, k: int, n_slots: int) -> Column:
    return F.shiftrightunsigned(gram, _HASH_BITS * k).bitwiseAND(F.lit(n_slots - 1).cast("long"))


def predict(docs: DataFrame, filters: LanguageFilters, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep, lang_pred, score`` per row of ``docs(text)``.

    ``score`` is the share of the text's n-grams, less chance, that the
    language holds.  Null texts, those without a letter, and all texts under
    filters without a language are ``und`` with score 0.  Texts of any length
    are read whole; other columns are not read; no rows give none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    rows = only(docs, *keep, "text")
    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.decide(batch[len(keep)].to_pylist())
            columns = [batch[i] for i in range(len(keep))]
            columns += [pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "lang_pred", "score"])

    return rows.mapInArrow(run, f"{kept}, lang_pred string, score double")


def held_out_of(doc_id: Column, parts: int = 5) -> Column:
    """Whether a document is held out of learning, by its id; rows without an id are."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == 0


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: filters of the documents not held out, applied to all."""
    told = docs.withColumn("held_out", held_out_of(F.col("doc_id")))
    filters = learn(told.where(~F.col("held_out")))
    return predict(told, filters, ("doc_id", "held_out"))
