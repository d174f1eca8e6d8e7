"""The registered queries of the subpackage, each over its whole table, and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers

import corpus_pipeline

from . import bagminhash, bitslice, bpe, chat, collocations, decontaminate, divergence, idfiles, language, licenses, quality, shards, suffix
from .common import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_bit_sliced_topk(spark, folder):
    return bitslice.neighbours(table(spark, folder, "embeddings"))


def op2_language_id(spark, folder):
    return language.identify(table(spark, folder, "documents"))


def op3_chat_format(spark, folder):
    return chat.digests(table(spark, folder, "conversations"))


def op4_license_scan(spark, folder):
    return licenses.matches(table(spark, folder, "documents"))


def op5_byte_bpe(spark, folder):
    return bpe.digests(table(spark, folder, "documents"), RANKS, public_tokenizers.PATTERN)


def op6_site_quality(spark, folder):
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_stratified_shards(spark, folder):
    return shards.sharding(table(spark, folder, "documents"))


def op8_bagminhash_near_dedup(spark, folder):
    return bagminhash.near_duplicates(table(spark, folder, "documents"))


def op9_decontamination(spark, folder):
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op10_suffix_dedup(spark, folder):
    return suffix.removal(table(spark, folder, "documents"))


def op11_source_divergence(spark, folder):
    return divergence.audit(table(spark, folder, "documents"))


def op12_collocations(spark, folder):
    return collocations.collocations(table(spark, folder, "documents"))


def op13_token_files(spark, folder):
    return idfiles.digests(table(spark, folder, "documents"), WORD_VOCABULARY)


QUERIES = {f.__name__: f for f in (op1_bit_sliced_topk, op2_language_id, op3_chat_format, op4_license_scan, op5_byte_bpe, op6_site_quality, op7_stratified_shards,
                                 op8_bagminhash_near_dedup, op9_decontamination, op10_suffix_dedup, op11_source_divergence, op12_collocations, op13_token_files)}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLES = {"op1_bit_sliced_topk": bitslice.ORACLE, "op11_source_divergence": divergence.ORACLE, "op12_collocations": collocations.ORACLE}
