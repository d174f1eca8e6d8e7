"""Corpus pipeline: language ID, near-duplicates, repeated passages, benchmark leaks, tokens.

Each stage works on all that its predecessor kept and is written as Parquet
before the next one starts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bagminhash, bpe, decontaminate, language, suffix
from plumbline.llm.common import stored, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Least likeness to the nearest language profile; what is below is no language that was learned.
LEAST_LANGUAGE_SCORE = 0.1


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or unlike every learned language, go."""
    return language.readable(docs, LEAST_LANGUAGE_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the least id stays."""
    return bagminhash.one_of_each(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of 200 bytes that occur again are cut out; emptied documents go."""
    return suffix.without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and whether they decode to the text; documents that do not would go."""
    coded = bpe.both_ways(docs, RANKS, public_tokenizers.PATTERN)
    return coded.where(F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).drop("decoded")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup),
          ("decontamination", decontamination), ("byte_bpe", byte_bpe)]

#: Rank-order profiles, signatures and merges are beyond SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
