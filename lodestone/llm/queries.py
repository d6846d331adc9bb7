"""The queries of the training-data operators and the DuckDB SQL that they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import common, conversation_repair, decontaminate, jaccard_join, language_id, license_scan, lm_score, prefix_trie, quality_rules, secret_scan, substring_dedup, toxicity, url_filter
from .sentencepiece_codec import sentencepiece_encode

PIECES = f"{common.TOKENIZER_DIR}/piece_bpe_32k.model"


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text."""
    return sentencepiece_encode(common.table(spark, sf_dir, "documents"), PIECES)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text."""
    return secret_scan.secret_scan(common.table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a benchmark item every whole text holds."""
    return decontaminate.decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, fixed rules and the trees' verdict of every whole text."""
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    return quality_rules.quality_rules(docs, quality_rules.train_quality(docs, labels))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every whole text, learnt from labels that are not held out."""
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    return toxicity.toxicity(docs, toxicity.train_toxicity(docs, labels))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of every url."""
    return url_filter.filter_urls(common.table(spark, sf_dir, "pages"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near copies of every document."""
    return jaccard_join.jaccard_join(common.table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of every text repeats a passage that stands earlier."""
    return substring_dedup.substring_dedup(common.table(spark, sf_dir, "documents"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every text; the target is what labels call good."""
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    return lm_score.corpus_scores(docs, labels.where("quality = 1"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every whole text."""
    return license_scan.license_scan(common.table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations, with the sums of its subtree."""
    return prefix_trie.conversation_trie(common.table(spark, sf_dir, "conversations"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after the damage, its faults and its cheapest repair."""
    return conversation_repair.conversation_repair(common.table(spark, sf_dir, "conversations"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, by profiles of the documents that are not held out."""
    docs = common.table(spark, sf_dir, "documents")
    return language_id.language_id(docs, language_id.train_languages(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secret_scan": secret_scan.oracle_sql(),
        "op5_url_filter": url_filter.oracle_sql(),
        "op6_jaccard_join": jaccard_join.oracle_sql(),
        "op7_substring_dedup": substring_dedup.oracle_sql(),
        "op10_license_scan": license_scan.oracle_sql(),
        "op11_prefix_trie": prefix_trie.oracle_sql(),
    }
