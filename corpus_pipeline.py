"""A training-data pipeline of five stages over ``documents``.

Each stage takes what the one before kept, written as Parquet and read again.
Every stage takes an empty table, and columns beyond those of ``documents``,
which it leaves out.
The last one has no SQL form, so neither has the whole; tests hold each stage
against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm.bpe import bpe
from ragloom.llm.decontaminate import decontaminate
from ragloom.llm.neardup import drop_near_duplicates
from ragloom.llm.quality import good
from ragloom.llm.suffixes import deduplicate_bytes
from ragloom.session import stash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; null and empty texts are rejected, repeated rows are judged alike."""
    return good(docs.select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id; texts without words, rows with a null id, and repeats of a row that stays all stay."""
    return drop_near_duplicates(docs, n=5, percent=80).select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of repeated 100-byte strings go, and a character that is cut; a document of which nothing is left goes too, as an empty one does."""
    cut = deduplicate_bytes(docs, keep_text=True, carry=["lang", "source"]).where("kept_text <> ''")
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each row by its own text; an empty benchmark takes none."""
    return decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, a row for each document; null and empty texts have none."""
    import public_tokenizers

    return bpe(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
