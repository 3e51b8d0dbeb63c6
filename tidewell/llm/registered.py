"""One query per operator over its whole table, each with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import (
    alignment,
    conversations,
    extraction,
    languages,
    packing,
    quality,
    records,
    scoring,
    simhash,
    suffix,
    topk,
    transducer,
    urls,
)
from tidewell.llm.comparison import SQL  # noqa: F401
from tidewell.session import prepare


def settle(spark: SparkSession) -> None:
    """Session settings: those of the library, and batches for Python bounded in bytes, as texts may be long."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    settle(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    """The tokenizer file of the packing and record queries."""
    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), word_tokenizer(), end_id=1, size=2048)


def op2_html_extraction(spark, sf_dir):
    return extraction.extract(table(spark, sf_dir, "pages"))


def op3_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), distance=4, words=4)


def op4_url_filter(spark, sf_dir):
    return urls.filter_urls(table(spark, sf_dir, "pages"), urls.rule_table(spark, urls.RULES))


def op5_quality_rules(spark, sf_dir):
    return quality.clean_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op6_token_records(spark, sf_dir):
    root = records.record_root(spark)
    manifest = records.write_records(table(spark, sf_dir, "documents"), word_tokenizer(), end_id=2, root=root)
    return records.digest_records(manifest, root)


def op7_suffix_dedup(spark, sf_dir):
    return suffix.digest(table(spark, sf_dir, "documents"), window=400, words=51)


def op8_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op9_sentencepiece(spark, sf_dir):
    model = public_tokenizers.path("piece_bpe_32k.model")
    return transducer.encode_table(table(spark, sf_dir, "documents"), model, merges=True)


def op10_lm_scoring(spark, sf_dir):
    return scoring.score(table(spark, sf_dir, "documents"))


def op11_language_id(spark, sf_dir):
    return languages.identify(table(spark, sf_dir, "documents"))


def op12_alignment(spark, sf_dir):
    byte_bpe, pieces = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.link_table(table(spark, sf_dir, "documents"), byte_bpe, pieces)


def op13_conversation_repair(spark, sf_dir):
    return conversations.digest(conversations.damage(table(spark, sf_dir, "conversations")))


_REGISTERED = (
    op1_packing,
    op2_html_extraction,
    op3_simhash,
    op4_url_filter,
    op5_quality_rules,
    op6_token_records,
    op7_suffix_dedup,
    op8_top_k,
    op9_sentencepiece,
    op10_lm_scoring,
    op11_language_id,
    op12_alignment,
    op13_conversation_repair,
)
QUERIES = {f.__name__: f for f in _REGISTERED}
