"""Queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, linededup, mixing, repair
from .ctw import lm_scores
from .embedjoin import embedding_components
from .packing import packing_digest
from .quality import quality_scores
from .simhash import simhash_components
from .suffix import repeats_digest
from .tokens import token_file_digest
from .toxicity import toxicity_scores
from .whitening import whiten

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; null and empty texts have fingerprint zero."""
    return simhash_components(_table(spark, sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and kept flag of every vector; unusable vectors link with nothing."""
    return embedding_components(_table(spark, sf_dir, "embeddings"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the token files, read back; null texts are empty and have the end id alone."""
    return token_file_digest(_table(spark, sf_dir, "documents"), _tokenizer())


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned outside the held-out fold; null texts are scored as empty."""
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that stand on ten sites or more; null texts stay null."""
    return linededup.dedup_report(_table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document under the context tree and the word counts; null texts are empty."""
    return lm_scores(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids; null texts have the end id alone."""
    return packing_digest(_table(spark, sf_dir, "documents"), _tokenizer())


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned outside the held-out fold; null texts are scored as empty."""
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without the repeated 200-byte strings; null texts are empty."""
    return repeats_digest(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and benchmark items that they hold; null texts and items hold nothing."""
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage, cheapest repair and its audit for every conversation; null roles and texts are one blank."""
    return repair.repair_digest(_table(spark, sf_dir, "conversations"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, its source's size and target; null texts have size 0."""
    return mixing.mixing_digest(_table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every usable vector."""
    return whiten(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_simhash_near_dedup, op2_embedding_near_dedup, op3_token_files, op4_toxicity, op5_line_dedup, op6_lm_scoring, op7_packing,
        op8_quality, op9_suffix_dedup, op10_decontamination, op11_conversation_repair, op12_source_mixing, op13_embedding_whitening,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": linededup.ORACLE, "op10_decontamination": decontam.ORACLE, "op11_conversation_repair": repair.ORACLE, "op12_source_mixing": mixing.ORACLE}
