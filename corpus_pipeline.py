"""From raw documents to token ids: clean, drop near copies, decontaminate, mix, encode.

Every stage takes the documents that the stage before kept and returns documents with the same columns; the last one
writes the token shards and returns a row for each document read back from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessionloom.llm import minhash_bayes, mixture, qgram_bands, quality_lines, repair_codec
from sessionloom.llm.registry import vocabulary
from sessionloom.session import discard, materialize

WORD_VOCABULARY = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the line and document rules, without their failed lines."""
    return quality_lines.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash_bayes.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return qgram_bands.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words of each source that its weight asks for, as documents."""
    return mixture.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of every document in the written shards."""
    return repair_codec.encoded_digests(docs, vocabulary(WORD_VOCABULARY))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_ids", token_ids),
]

#: Near copies, alignment, keyed permutations and a tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each stage's result stored before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stored: list[DataFrame] = []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        stored.append(docs)
    result = STAGES[-1][1](spark, docs, sf_dir)
    discard(*stored)
    return result
