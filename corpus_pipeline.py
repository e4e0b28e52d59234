"""Corpus pipeline: quality rules, near-copy removal, repeated-passage removal, decontamination, tokens.

Each stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor
kept and returns a DataFrame, which ``run`` writes as Parquet to the shared
checkpoint folder and rereads as the next stage's ``docs``.  All but the last
return the columns of ``documents``; the last adds ``token_ids`` and sets
``text`` to what the ids decode to.

Rows: a document with a null or empty text fails the first stage.  Of a group of
near copies the smallest id stays.  A text that consists of repeated passages
only stays as an empty text.  Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, jaccard_join, quality_rules, suffix_dedup
from tessera.llm.storage import materialise
from tessera.sources.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
POLICY = "v2"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    return quality_rules.ledger(docs.select(*COLUMNS)).where(quality_rules.kept(POLICY)).select(*COLUMNS)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard_join.deduplicate(docs.select(*COLUMNS))


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes or more that occur elsewhere."""
    cut = suffix_dedup.clean_texts(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text that they decode to."""
    import public_tokenizers

    vocab = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encode_documents(docs.select(*COLUMNS), vocab, public_tokenizers.PATTERN)
    return bpe.decode_documents(ids.drop("text"), vocab).select(
        "doc_id", F.col("decoded").cast("string").alias("text"), "lang", "source", "n_chars", "token_ids")


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", near_copy_stage),
    ("suffix_array_dedup", passage_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("byte_bpe", token_stage),
]

# No stage after the first is SQL: chosen paths, MinHash and BPE; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
