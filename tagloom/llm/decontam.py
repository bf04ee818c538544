"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

The question is how much of a short test item lies inside a long document, so
only the item is sketched: its floor((1 - t) * q) + 1 smallest shingle hashes, of q
distinct ones. If a document holds at least the share t of an item, it misses fewer shingles
than the sketch has, so it must hold one of the sketch: no leak is overlooked. Banded
MinHash over whole documents would compare sets of very unequal sizes (a Jaccard
similarity near 0.001) and miss most.

Items are partitioned by size, in powers of two of the shingles that a match needs, and
a document is probed only against the partitions that its own length can reach: one with fewer
shingles than the least need of a partition cannot match in it. Items shorter than a shingle
are partitions of their own, compared with the document's runs of that many words.
Candidates are verified on the words.

Words are runs of ASCII letters, digits and all other characters beyond ASCII, with A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_chunks

BLOCK_BYTES = 32 << 20
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


class _WordHashes(dict):
    """Hashes of words seen so far; cleared when it holds many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _WordHashes()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD).split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """A hash for each shingle of ``size`` words by place; none of fewer words."""
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out += h[i : i + n] * _FACTORS[i]
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _grams(words: list[bytes], size: int, places) -> Iterator[bytes]:
    return (b" ".join(words[p : p + size]) for p in places)


class SizePartition:
    """Sketches and whole shingle sets of items of one shingle length and one class of size."""

    def __init__(self, size: int, members: list[tuple[int, dict[bytes, int], int]]):
        self.size, self.members, self.least = size, members, min(need for *_, need in members)
        sketch, owner = [], []
        for at, (_, grams, need) in enumerate(members):
            smallest = sorted(set(grams.values()))[: len(grams) - need + 1]
            sketch += smallest
            owner += [at] * len(smallest)
        order = np.argsort(np.array(sketch, np.uint64), kind="stable")
        self.sketch, self.owner = np.array(sketch, np.uint64)[order], np.array(owner, np.int64)[order]
        self.low = np.zeros(1 << 16, bool)
        self.low[(self.sketch & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.hashes = [np.array(sorted(set(grams.values())), np.uint64) for _, grams, _ in members]

    def match(self, words: list[bytes], h: np.ndarray) -> Iterator[tuple[int, int, int]]:
        probe = np.unique(h[self.low[(h & np.uint64(0xFFFF)).astype(np.int64)]])
        lo, hi = np.searchsorted(self.sketch, probe), np.searchsorted(self.sketch, probe, "right")
        for i in sorted({int(i) for a, b in zip(lo, hi) for i in self.owner[a:b]}):
            item_id, grams, need = self.members[i]
            at = np.flatnonzero(np.isin(h, self.hashes[i]))
            shared = len(set(_grams(words, self.size, at)) & grams.keys())
            if shared >= need:
                yield item_id, shared, len(grams)


class ItemIndex:
    """A bounded block of items, partitioned by size. Rows of one item_id are items of their own."""

    def __init__(self, items: list[tuple[int, str]], size: int, share: float):
        classes: dict[tuple[int, int], list] = {}
        for item_id, text in items:
            w = words_of(text)
            if w:
                k = min(size, len(w))
                h = shingle_hashes(w, k)
                grams = dict(zip(_grams(w, k, range(len(h))), h.tolist()))
                need = _least(share, len(grams))
                classes.setdefault((k, need.bit_length()), []).append((item_id, grams, need))
        self.partitions = [SizePartition(k, members) for (k, _), members in sorted(classes.items())]

    def match(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, shared distinct shingles, shingles of the item) of every item that the text contains."""
        words = words_of(text)
        hashed: dict[int, np.ndarray] = {}
        out = []
        for p in self.partitions:
            if len(words) - p.size + 1 >= p.least:
                if p.size not in hashed:
                    hashed[p.size] = shingle_hashes(words, p.size)
                out += p.match(words, hashed[p.size])
        return out


def _least(share: float, q: int) -> int:
    """The smallest count that is at least the share of q."""
    return next(n for n in range(int(share * q), q + 1) if n >= share * q - 1e-9)


def _blocks(items: DataFrame, limit: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``limit`` bytes, each small enough to broadcast."""
    known = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // limit)
    for k in range(n):
        yield [tuple(r) for r in known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()]


def contaminated(docs: DataFrame, items: DataFrame, share: float = 0.8, size: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pairs of a document and a test item of which it holds at least ``share``.

    docs(doc_id, text, ..), items(item_id, text, ..) -> doc_id, item_id, shared and
    item_shingles (distinct shingles of ``size`` words), containment. Null and blank texts
    match nothing; an item of fewer words than ``size`` is one shingle and lies in every
    document that has these words in a row. Repeated items count once; repeated documents each give rows.
    """
    schema = "doc_id long, item_id long, shared long, item_shingles long"
    spark, out = docs.sparkSession, None
    for block in _blocks(items, block_bytes):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(sent.value, size, share)
            for b in text_chunks(batches, "text"):
                rows = [
                    (doc, *found)
                    for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())
                    for found in index.match(text)
                ]
                cols = list(zip(*rows)) or [()] * 4
                yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "shared", "item_shingles"])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    out = spark.createDataFrame([], schema) if out is None else out
    return out.withColumn("containment", F.col("shared") / F.col("item_shingles"))


def drop_contaminated(docs: DataFrame, items: DataFrame, share: float = 0.8, size: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that hold no test item, as ``contaminated`` finds it; all columns stay, and no row is moved.

    Null and blank texts stay; of repeated documents all stay or go. Without items or documents nothing changes.
    """
    kept = docs
    for block in _blocks(items, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(sent.value, size, share)
            for b in text_chunks(batches, "text"):
                yield b.filter(pa.array([not index.match(t) for t in b.column("text").to_pylist()], pa.bool_()))

        kept = kept.mapInArrow(run, docs.schema)
    return kept


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM documents),
i AS (SELECT item_id, row_number() OVER (ORDER BY item_id, text) AS ik, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
bs AS (SELECT DISTINCT item_id, ik, least(len(w), 5) AS k, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda p: array_to_string(w[p:p + least(len(w), 5) - 1], ' '))) AS s FROM i WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bs),
ds AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' '))) AS s FROM d JOIN ks ON len(w) >= k),
n AS (SELECT ik, count(*) AS item_shingles FROM bs GROUP BY ik)
SELECT ds.doc_id, bs.item_id, count(*) AS shared, n.item_shingles, count(*) / n.item_shingles AS containment
FROM ds JOIN bs ON ds.s = bs.s AND ds.k = bs.k JOIN n ON n.ik = bs.ik
GROUP BY ds.doc_id, bs.item_id, bs.ik, n.item_shingles HAVING count(*) >= 0.8 * n.item_shingles - 1e-9
"""
