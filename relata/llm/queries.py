"""The operators of this subpackage over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embeddings, langid, licenses, mixing, packing, quality, simhash, substring, tokens
from .common import table
from .oracle import ORACLE


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn of conversations as a call and every assistant turn as its result, linked, ordered, validated."""
    out = chat.format_messages(chat.from_turns(table(spark, sf_dir, "conversations")))
    return out.withColumns({c: F.col(c).cast("long") for c in ("n_calls", "n_invalid", "level")})


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), "piece_bpe_32k.model").select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", F.round("rate", 6).alias("rate"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = langid.fit(docs, F.col("doc_id").isNotNull() & ~langid.held_out())
    return langid.identify(docs.select("doc_id", "text", langid.held_out().alias("held_out")), models).drop("text")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs.select("doc_id", "text"), licenses.Classifier(licenses.sample(docs)))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = quality.fit(docs, quality.trusted_ids(table(spark, sf_dir, "labels")))
    return quality.judge(docs.select("doc_id", "text"), weights).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op8 that don't come from its model."""
    facts = quality.base(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", facts.alias("f")).select("doc_id", "f.*")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return found | {"quality_base_counts": quality_base_counts}


def oracle_sql() -> dict[str, str]:
    return ORACLE
