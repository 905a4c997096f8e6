"""The corpus pipeline: documents to token ids, stage by stage.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read
again for the next; all but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrymill.llm import bpe, dedup, langid, mixing, quality
from quarrymill.llm.registry import tokenizer
from quarrymill.llm.staging import Staging


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail go, and documents that fail the base rules or lose too much text."""
    return quality.apply_rules(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no learned language accepts go."""
    return langid.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, at five words and 0.8, the document with the least id stays."""
    return dedup.keep_one(docs, Staging(spark, "pipeline-dedup"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document comes as often as it is taken."""
    return mixing.mix(docs, Staging(spark, "pipeline-mix"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding them."""
    ranks, pattern = tokenizer()
    return bpe.round_trip(docs, ranks, pattern).select("doc_id", "ids", "n_tokens", "decoded_sha256")


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", source_mixing),
    ("byte-level BPE encoding and decoding", byte_bpe),
]
#: Hash signatures and learned models have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    staging = Staging(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        following = staging.write(out)
        if i:
            staging.drop(docs)
        docs = following
