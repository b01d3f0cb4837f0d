"""The queries of this subpackage by name, and DuckDB SQL for those that SQL can express.

None reads columns beyond those that its contract names, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm import oracles
from ragloom.llm.bpe import bpe
from ragloom.llm.conversations import repair_conversations
from ragloom.llm.decontaminate import contained_items
from ragloom.llm.divergence import source_divergence
from ragloom.llm.html import extract
from ragloom.llm.lm import lm_scores
from ragloom.llm.neardup import near_duplicates
from ragloom.llm.quality import quality
from ragloom.llm.sharding import assign_shards
from ragloom.llm.substrings import deduplicate_words
from ragloom.llm.suffixes import deduplicate_bytes
from ragloom.llm.topk import pivot_top_k
from ragloom.llm.toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts give zeros; repeated rows each give a row and don't remove each other's bytes; a null doc_id is not judged; an empty table gives none."""
    return deduplicate_bytes(_table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty pages give an empty text; repeated rows stay; an empty table gives none."""
    return extract(_table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts get the constant's score; repeated rows each give a row; without labels every score is 0.5."""
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each item found in a document; null and empty texts hold nothing and are never found; repeated document rows give repeated rows."""
    return contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have one token, their end; a null doc_id is in training; repeated rows stay; an empty table gives none."""
    return lm_scores(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have zeros and fail the base rule; every row comes back once, repeated ones too."""
    out = quality(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without words are linked with nothing; repeated rows are one document, each with its row; the smallest doc_id stands for ties; a null doc_id is kept alone."""
    return near_duplicates(_table(spark, sf_dir, "documents"), n=4)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have no tokens; repeated rows stay; an empty table gives none."""
    import public_tokenizers

    return bpe(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null text counts 8 bytes; a null doc_id counts as the empty key; equal keys share a shard and have slots of their own."""
    return assign_shards(_table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have no words; repeated rows each give a row and don't remove each other's words; a null doc_id is not judged."""
    return deduplicate_words(_table(spark, sf_dir, "documents"))


def op11_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null vectors, and those with a null or a component that is not finite, take no part; equal rows count once; fewer rows give shorter lists; an empty table gives none."""
    return pivot_top_k(_table(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls read as ''; a group without terms has zero counts; repeated rows are documents of their own; an empty table gives none."""
    return source_divergence(_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls are one blank, a null conv_id is a conversation; a conversation without rows left has zeros; an empty table gives none."""
    return repair_conversations(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_html_extraction, op3_toxicity, op4_decontamination, op5_lm_scoring, op6_quality_rules, op7_near_duplicates, op8_bpe, op9_sharding, op10_substring_dedup, op11_pivot_top_k, op12_source_divergence, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": oracles.CONTAINMENT, "op6_quality_rules": oracles.QUALITY, "op7_near_duplicates": oracles.NEAR_DUPLICATES, "op9_sharding": oracles.SHARDING, "op10_substring_dedup": oracles.SUBSTRINGS, "op11_pivot_top_k": oracles.TOP_K, "op12_source_divergence": oracles.DIVERGENCE}
