"""Line-first quality rules (operator 5), in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.bind import bind
from tidewell.llm.columns import SPACE, let, occurrences, only, words_of

SYMBOL = r"[#*$%&|<>]"
SEPARATOR = r"[|>•·»]"
#: Phrases of notices and page furniture; they count in lines of at most NOTICE_WORDS words.
NOTICE = (
    r"(?i)(licen[sc]ed under|all rights reserved|\bcopyright\b|©|terms of (use|service)|privacy policy"
    r"|\bcookies?\b|\bsubscribe\b|\bsign (in|up)\b|\blog ?in\b|enable javascript|click here|read more|powered by)"
)
NOTICE_WORDS = 25
ENDING = r"[.!?…:;\"'”’»)\]。！？]$"
#: A line of fewer words must end like a sentence.
OPEN_WORDS = 8
MIN_WORDS = 50
#: Shares in percent: symbols of a line's words, separators of a line's words, words lost by a document.
SYMBOL_SHARE, SEPARATOR_SHARE, LOST_SHARE = 30, 20, 50


def line_fails(line: Column, n_words: Column) -> Column:
    """Punctuation (no ending, or symbols for words), navigation and notice rules of one line."""
    trimmed = F.regexp_replace(line, f"[{SPACE}]+$", "")
    open_ended = (n_words < OPEN_WORDS) & ~trimmed.rlike(ENDING)
    symbols = occurrences(line, SYMBOL) * 100 > n_words * SYMBOL_SHARE
    navigation = occurrences(line, SEPARATOR) * 100 > n_words * SEPARATOR_SHARE
    notice = (n_words <= NOTICE_WORDS) & line.rlike(NOTICE)
    return open_ended | symbols | navigation | notice


def _repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more."""

    def covered(windows: Column) -> Column:
        keyed = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k)["w"] == x["w"], F.lit(False))
            twice = F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def width(p: Column) -> Column:
            steps = F.transform(p, lambda v, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - v, F.lit(3))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        # sorting is for the few texts that repeat a window at all
        some = F.size(F.array_distinct(windows)) < F.size(windows)
        return F.when(some, let(let(keyed, repeated), width)).otherwise(0)

    windows = lambda w: F.transform(
        F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    )
    return let(words, lambda w: F.when(F.size(w) < 3, 0).otherwise(let(windows(w), covered)))


def clean_lines(docs: DataFrame) -> DataFrame:
    """Adds the counts, the verdict and the cleaned text to ``docs(doc_id, text)``.

    Columns: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, lost_words, kept, clean_text``.  Lines are
    judged first and failing ones removed; a document that loses more than
    LOST_SHARE percent of its words, or fails the base counts, is not kept.
    Null and empty texts have zero counts and are not kept; lines without a
    word are neither judged nor removed; each repeated row is judged for
    itself; other columns are not read.
    """
    rows = bind(only(docs, "doc_id", "text"), "body", F.coalesce("text", F.lit(""))).drop("text")
    rows = bind(rows, "words", words_of(F.col("body")))
    # one struct per line: its text, its number of words, whether it fails
    lines = F.transform(
        F.split("body", "\n", -1),
        lambda x: let(
            F.size(words_of(x)),
            lambda n: F.struct(x.alias("line"), n.alias("n"), ((n > 0) & line_fails(x, n)).alias("fails")),
        ),
    )
    rows = bind(rows, "lines", lines)
    worded = F.transform(F.filter("lines", lambda x: x["n"] > 0), lambda x: x["line"])
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x["n"])
    rows = rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        occurrences(F.col("body"), SYMBOL).cast("long").alias("n_symbols"),
        let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        total(F.filter("lines", lambda x: x["fails"])).cast("long").alias("lost_words"),
        F.array_join(F.transform(F.filter("lines", lambda x: ~x["fails"]), lambda x: x["line"]), "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    lost = F.col("lost_words") * 100 > F.col("n_words") * LOST_SHARE
    return rows.withColumns({"base_failed": failed, "kept": ~failed & ~lost})


def keep_clean(docs: DataFrame) -> DataFrame:
    """The kept rows of ``documents``, all columns, with the cleaned text and its ``n_chars``.

    The verdict travels in the same row, so no join is needed.
    """
    names = docs.columns
    carried = docs.select(F.struct(*(F.col(f"`{n}`") for n in names)).alias("doc_id"), "text")
    judged = clean_lines(carried).where("kept")
    changed = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return judged.select(*(changed.get(n, F.col("doc_id")[n]).alias(n) for n in names))
