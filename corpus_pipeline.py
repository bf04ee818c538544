"""A corpus pipeline: filter, clean, deduplicate, decontaminate and pack ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; between
stages the documents are written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tagloom.llm import decontam, linededup, packing, quality, simhash
from tagloom.llm.common import shared_dir
from tagloom.llm.entry import TOKENIZER


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each line that stands on many sites one occurrence stays."""
    return linededup.dedup_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, Jaccard 0.8) one document stays."""
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of sequences of 2048 ids."""
    import public_tokenizers

    return packing.packing_digest(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality classifier", filter_quality),
    ("line dedup", dedup_lines),
    ("simhash near-dedup", dedup_documents),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]

#: The classifier, SimHash and the tokenizer are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order, over the whole table ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = f"{shared_dir(spark)}/{uuid.uuid4().hex}/stage{i}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
