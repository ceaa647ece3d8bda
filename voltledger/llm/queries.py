"""The corpus operators as queries over the given tables, with the parameters used in production."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import oracle
from .alignment import align_tokens, summarise_alignment
from .common import read
from .decontam import contaminated
from .language import identify_documents
from .licenses import scan_licenses
from .neardup import near_duplicates
from .packing import pack_documents
from .repeats import remove_repeats
from .runs import collapse_runs, summarise_runs, with_derived_runs
from .scoring import score_documents
from .shards import shard_documents
from .tokencount import count_with_edits, derived_edits
from .toxicity import score_documents as score_toxicity
from .vectors import near_duplicate_vectors

PACK_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ALIGNED_TOKENIZERS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN
COUNT_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_with_edits(derived_edits(read(spark, sf_dir, "documents")), "edits", COUNT_RANKS, public_tokenizers.PATTERN)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_documents(read(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), PACK_TOKENIZER)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"))


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(read(spark, sf_dir, "embeddings"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarise_runs(collapse_runs(with_derived_runs(read(spark, sf_dir, "documents"))))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarise_alignment(align_tokens(read(spark, sf_dir, "documents"), *ALIGNED_TOKENIZERS))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_near_dedup, op2_lm_scoring, op3_token_counts, op4_language_id, op5_suffix_dedup, op6_decontamination, op7_packing, op8_license_scan, op9_sharding, op10_vector_dedup, op11_periodic_runs, op12_toxicity, op13_token_alignment)}
ORACLE_SQL: dict[str, str] = oracle.SQL
