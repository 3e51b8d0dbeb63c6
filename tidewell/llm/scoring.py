"""Language-model scores of documents: byte PPM, beside a unigram base (operator 10)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.columns import only
from tidewell.llm.ppm import ALPHABET, BITS, find, grams
from tidewell.sources.storage import cut_lineage

ORDER = 5
#: Entries of the two tables that go to every worker: scores of the commonest grams and of the commonest words.
#: They only stand in front of joins, by which all other grams and words are looked up.
MODEL_GRAMS, MODEL_WORDS = 1 << 21, 1 << 18
#: Symbols handled at once, and entries a task holds before it hands them on.
_SYMBOLS, _HELD = 1 << 21, 1 << 21
#: The end token; no word is empty.
END_WORD = ""

_COUNTS = "gram long, word string, n long"


def _count(order: int):
    schema = pa.schema([("gram", pa.int64()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        waiting: list[np.ndarray] = []
        counted: list[tuple[np.ndarray, np.ndarray]] = []
        symbols = 0

        def settle() -> None:
            nonlocal symbols
            if waiting:
                counted.append(np.unique(np.concatenate(waiting), return_counts=True))
            waiting.clear()
            symbols = 0
            if sum(len(k) for k, _ in counted) > _HELD and len(counted) > 1:
                keys, place = np.unique(np.concatenate([k for k, _ in counted]), return_inverse=True)
                total = np.zeros(len(keys), np.int64)
                np.add.at(total, place, np.concatenate([n for _, n in counted]))
                counted[:] = [(keys, total)]

        def gram_rows() -> Iterator[pa.RecordBatch]:
            for keys, n in counted:
                arrays = [pa.array(keys.view(np.int64)), pa.nulls(len(keys), pa.string()), pa.array(n)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)
            counted.clear()

        def word_rows() -> pa.RecordBatch:
            seen = pa.array(list(words.keys()), pa.binary()).cast(pa.string())
            arrays = [pa.nulls(len(words), pa.int64()), seen, pa.array(list(words.values()), pa.int64())]
            words.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for batch in batches:
            for text in batch[0].cast(pa.binary()):
                data = (text.as_py() or b"").lower()
                words.update(data.split())
                words[END_WORD.encode()] += 1
                for at in range(0, len(data) + 1, _SYMBOLS):  # long texts in parts, with the context before each
                    part = grams(data, order) if len(data) < _SYMBOLS else _part(data, at, order, _SYMBOLS)
                    waiting.append(part)
                    symbols += len(part)
                    if symbols >= _SYMBOLS:
                        settle()
            if len(words) > _HELD // 4:
                yield word_rows()
            if sum(len(k) for k, _ in counted) > _HELD:
                yield from gram_rows()
        settle()
        yield from gram_rows()
        yield word_rows()

    return run


def _part(data: bytes, at: int, order: int, most: int) -> np.ndarray:
    """Grams of the symbols from ``at`` on, ``most`` at most; the last part holds the end."""
    begin, end = max(0, at - order), min(len(data), at + most)
    found = grams(data[begin:end], order)[at - begin :]
    if begin:  # the grams of the first symbols have their context, as it was cut out with them
        found = found[: end - at + 1]
    return found if at + most > len(data) else found[:-1]


def least_count(counts: DataFrame, most: int) -> int:
    """The smallest power of two that at most ``most`` rows' ``n`` reach."""
    powers = [1 << k for k in range(48)]
    reached = counts.agg(*(F.count_if(F.col("n") >= p) for p in powers)).first()
    return next(p for p, n in zip(powers, reached, strict=True) if n <= most)


def _model(counts: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """The trie of all orders as tables: ``order, key, n`` of every gram, and what each context gives and leaves.

    ``order, context, total, kinds`` count a context's symbols; ``weight`` and
    ``weight_kinds`` are what is left one order below once they are excluded.
    A key meets at most one row per symbol in each join, so none is hot.
    """
    forms = [
        F.struct(F.lit(j).alias("order"), F.col("gram").bitwiseAND((1 << BITS * (j + 1)) - 1).alias("key")) for j in range(order + 1)
    ]
    every = counts.where("word IS NULL").select(F.inline(F.array(*forms)).alias("order", "key"), "n")
    every = cut_lineage(every.groupBy("order", "key").agg(F.sum("n").alias("n")))
    below = F.expr(f"key & (shiftleft(1L, {BITS} * order) - 1)")
    lower = every.select((F.col("order") + 1).alias("order"), F.col("key").alias("below"), F.col("n").alias("n_below"))
    contexts = (
        every.withColumn("below", below)
        .join(lower, ["order", "below"], "left")
        .groupBy("order", F.shiftright("key", BITS).alias("context"))
        .agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum("n_below").alias("shared"))
    )
    contexts = cut_lineage(contexts)
    parent = F.expr(f"context & (shiftleft(1L, {BITS} * greatest(order - 1, 0)) - 1)")
    lower = contexts.select(
        (F.col("order") + 1).alias("order"), F.col("context").alias("parent"), F.col("total").alias("total_below"), F.col("kinds").alias("kinds_below")
    )
    left, left_kinds = F.col("total_below") - F.col("shared"), F.col("kinds_below") - F.col("kinds")
    contexts = contexts.withColumn("parent", parent).join(lower, ["order", "parent"], "left")
    return every, cut_lineage(
        contexts.select("order", "context", "total", "kinds", (left + left_kinds).alias("weight"), left_kinds.alias("weight_kinds"))
    )


def _common_grams(every: DataFrame, contexts: DataFrame, order: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The commonest grams of the highest order, sorted, and their scores: a known gram needs no escape."""
    top = every.where(F.col("order") == order)
    top = top.where(F.col("n") >= least_count(top, most)).withColumn("context", F.shiftright("key", BITS))
    log = F.log10("n") - F.log10(F.col("total") + F.col("kinds"))
    found = top.join(contexts.where(F.col("order") == order).drop("order"), "context").select("key", log.alias("log")).toArrow()
    keys, logs = found["key"].to_numpy().view(np.uint64), found["log"].to_numpy()
    place = np.argsort(keys)
    return keys[place], logs[place]


def _gram_logs(asked: DataFrame, every: DataFrame, contexts: DataFrame, order: int) -> DataFrame:
    """``gram, log``: log10 of the probability of each distinct gram of ``asked(gram)`` under the whole model.

    Order by order, grams that the model has are settled and the others escape
    to the next lower one.
    """
    start = contexts.where(F.col("order") == 0).first()
    unseen = -float(np.log10(max(1, ALPHABET - (start["kinds"] if start else 0))))
    null = F.lit(None).cast("double")
    # under: weight of the order at hand after an escape; leave: log of the next escape
    open_ = asked.select("gram", F.lit(0.0).alias("log"), null.alias("under"), null.alias("leave"))
    settled = []
    for j in range(order, -1, -1):
        tables = every.where(F.col("order") == j).select("key", "n"), contexts.where(F.col("order") == j).drop("order")
        if j < 2:  # no more rows than pairs of symbols
            tables = tuple(F.broadcast(t) for t in tables)
        rows = open_.withColumn("key", F.col("gram").bitwiseAND((1 << BITS * (j + 1)) - 1)).withColumn("context", F.shiftright("key", BITS))
        rows = rows.join(tables[0], "key", "left").join(tables[1], "context", "left")
        fresh = F.log10(F.col("total") + F.col("kinds"))
        hit = F.log10("n") - F.coalesce("under", fresh)
        miss = F.coalesce("leave", F.log10("kinds") - fresh)
        log = F.col("log") + F.when(F.col("n").isNotNull(), hit).when(F.col("kinds").isNotNull(), miss).otherwise(0.0)
        known, weight = F.col("kinds").isNotNull(), F.log10(F.greatest("weight", F.lit(1)))
        leave = F.when(F.col("weight_kinds") > 0, F.log10("weight_kinds") - weight).otherwise(0.0)
        rows = cut_lineage(
            rows.select(
                "gram", log.alias("log"), F.when(known, weight).otherwise(F.col("under")).alias("under"),
                F.when(known, leave).otherwise(F.col("leave")).alias("leave"), F.col("n").isNotNull().alias("found"),
            )
        )
        settled.append(rows.where("found").select("gram", "log"))
        open_ = rows.where("NOT found").drop("found")
    logs = open_.select("gram", (F.col("log") + unseen).alias("log"))
    for more in settled:
        logs = logs.union(more)
    return logs


_SCORED = (
    "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, "
    "rest array<struct<word: string, times: long>>, rare array<struct<gram: long, times: long>>"
)


def _score(model, table, order: int):
    rest_type = pa.list_(pa.struct([("word", pa.string()), ("times", pa.int64())]))
    rare_type = pa.list_(pa.struct([("gram", pa.int64()), ("times", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), rest_type, rare_type]
    names = ("row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rest", "rare")
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def text_scores(common: tuple[np.ndarray, np.ndarray], texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
        """Sums over the common grams of each text, and its other grams with their numbers."""
        scores = np.zeros(len(texts))
        rare: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held, which, symbols = [], [], 0

        def settle() -> None:
            nonlocal symbols
            if held:
                distinct, place = np.unique(np.concatenate(held), return_inverse=True)
                at, found = find(common[0], distinct)
                logs = np.zeros(len(distinct))
                logs[found] = common[1][at[found]]
                sizes = np.fromiter(map(len, held), np.int64, len(held))
                np.add.at(scores, which, np.add.reduceat(logs[place], np.cumsum(sizes) - sizes))
                other = np.flatnonzero(~found[place])
                if len(other):
                    pairs = np.column_stack([np.repeat(which, sizes)[other], place[other]])
                    pairs, times = np.unique(pairs, axis=0, return_counts=True)
                    rare.append((pairs[:, 0], distinct[pairs[:, 1]].view(np.int64), times))
            held.clear()
            which.clear()
            symbols = 0

        for i, data in enumerate(texts):
            for at in range(0, len(data) + 1, _SYMBOLS):
                held.append(grams(data, order) if len(data) < _SYMBOLS else _part(data, at, order, _SYMBOLS))
                which.append(i)
                symbols += len(held[-1])
                if symbols >= _SYMBOLS:
                    settle()
        settle()
        # texts are met in order, so the rows of each lie together
        text, gram, times = (np.concatenate([r[k] for r in rare] or [np.empty(0, np.int64)]) for k in range(3))
        ends = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(gram), pa.array(times)], fields=list(rare_type.value_type))
        return scores, pa.ListArray.from_arrays(pa.array(ends), pairs).cast(rare_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, logs = model.value, table.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = [(t.as_py() or b"").lower() for t in batch[2].cast(pa.binary())]
            scores, rare = text_scores(common, texts)
            rows = []
            for doc_id, held_out, data, score in zip(batch[0].to_pylist(), batch[1].to_pylist(), texts, scores.tolist(), strict=True):
                times = Counter(data.split())
                times[END_WORD.encode()] = 1
                known, base, rest = 0, 0.0, []
                for word, n in times.items():
                    value = logs.get(word)
                    if value is None:
                        rest.append({"word": word.decode(), "times": n})
                    else:
                        known += n
                        base += n * value
                rows.append((row, doc_id, held_out, times.total(), known, base, score, rest))
                row += 1
            columns = list(zip(*rows, strict=True)) or [[]] * (len(schema) - 1)
            arrays = [pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([*arrays, rare], schema=schema)

    return run


def score(docs: DataFrame, order: int = ORDER, grams_kept: int = MODEL_GRAMS, words_kept: int = MODEL_WORDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row of ``docs(doc_id, text)``.

    Both models learn from all documents but those whose crc32 of the id is
    divisible by ten.  ``score`` is log10 of the probability that the byte
    trie gives to the text, A-Z lowered, and its end: the longest known context
    predicts; else it escapes (method C) to the next shorter one, without the
    symbols already excluded, down to an even chance.  ``base_score`` sums the
    smoothed log10 frequencies of its words and the end token.

    The model holds every gram of the training texts.  Grams beyond the
    ``grams_kept`` commonest get their scores by joins, words beyond the
    ``words_kept`` commonest their counts; the bounds change no result.  Null and empty texts are an end alone; texts of any length are
    scored whole; a null id counts as an empty one (held out); repeated rows
    are scored each; other columns are not read; without training documents
    every symbol has an even chance.
    """
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0
    rows = only(docs, "doc_id", "text").select("doc_id", held_out.alias("held_out"), "text")
    counts = rows.where("NOT held_out").select("text").mapInArrow(_count(order), _COUNTS)
    counts = cut_lineage(counts.groupBy("gram", "word").agg(F.sum("n").alias("n")))
    words = counts.where("word IS NOT NULL").select("word", "n")
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    share = lambda n: (n + 0.1) / (total + 0.1 * (kinds + 1))
    common = words.where(F.col("n") >= least_count(words, words_kept)).toArrow()
    table = dict(
        zip(common["word"].cast(pa.binary()).to_pylist(), np.log10(share(common["n"].to_numpy())).tolist(), strict=True)
    )
    context = docs.sparkSession.sparkContext
    every, contexts = _model(counts, order)
    model = context.broadcast(_common_grams(every, contexts, order, grams_kept))
    scored = cut_lineage(rows.mapInArrow(_score(model, context.broadcast(table), order), _SCORED))
    rest = scored.select("row", F.inline("rest").alias("word", "times")).join(words, "word", "left")
    rest = rest.select(
        "row",
        F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0).alias("known"),
        (F.col("times") * F.log10(share(F.coalesce("n", F.lit(0))))).alias("base"),
        F.lit(0.0).alias("log"),
    )
    rare = scored.select("row", F.inline("rare").alias("gram", "times"))
    logs = _gram_logs(rare.select("gram").distinct(), every, contexts, order)
    rare = rare.join(logs, "gram").select("row", F.lit(0).alias("known"), F.lit(0.0).alias("base"), (F.col("times") * F.col("log")).alias("log"))
    added = rest.union(rare).groupBy("row")
    added = added.agg(F.sum("known").alias("more_known"), F.sum("base").alias("more_base"), F.sum("log").alias("more_score"))
    return scored.drop("rest", "rare").join(added, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
