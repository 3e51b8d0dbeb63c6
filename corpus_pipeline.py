"""A corpus pipeline over ``documents``: line rules, near-duplicates, repeated strings, packing.

Every stage takes ``(spark, docs, sf_dir)`` and all rows its predecessor kept;
all but the last return the columns of ``documents``.  SQL cannot express
the near-duplicate, suffix and packing stages; the tests compare each with a
brute-force version.  Every stage takes null texts as empty, rows that repeat
and columns of any name, and gives no rows for none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import near_copies, packing, quality, suffix
from tidewell.llm.registered import settle, table, word_tokenizer
from tidewell.sources.storage import cut_lineage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, with the failing lines removed."""
    settle(spark)
    return quality.keep_clean(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8; the smallest id stays."""
    settle(spark)
    return near_copies.keep_one(docs, least=0.8, words=5)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the strings of 51 words, or of 400 bytes, that start anywhere else too."""
    settle(spark)
    return suffix.remove_repeats(docs, window=400, words=51)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 2048 tokens."""
    settle(spark)
    return packing.pack(docs, word_tokenizer(), end_id=1, size=2048)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
