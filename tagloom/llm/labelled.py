"""What the two classifiers share: folds by crc32 of doc_id and the labels outside one; for toxicity a bounded sample of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound on labelled rows that the toxicity classifier is fitted on; the rest of its labels is not used.
MAX_LABELLED = 20_000


def fold(folds: int) -> Column:
    """crc32 of doc_id as text, modulo ``folds``; a null doc_id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def known_labels(labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """(doc_id, y) of all labelled documents outside the held-out fold.

    Labels other than 0 and 1 are left out; of repeated labels the largest holds.
    """
    known = labels.where(F.col(label).isin(0, 1) & (fold(folds) != held_out))
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, limit: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, text, y) of at most ``limit`` labelled documents outside the held-out fold.

    Chosen by the hash of doc_id. The sample is small by its bound, so it is broadcast.
    """
    known = known_labels(labels, label, folds, held_out).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(known), "doc_id")
