"""Exact Jaccard similarity of word shingles: verification, and a prefix filter for what other candidates miss.

All shingles stand in one order: those of many texts last, then by hash. If two sets share at
least the part t of their union, the first n - ceil(t n) + 1 shingles of both (their prefixes) have
one in common, so texts meet at the shingles of their prefixes and no pair is overlooked. How
common a shingle is need not be exact for that: it is counted in 2**22 buckets. Texts that are
connected already are not compared again. Each candidate is verified on both whole sets.
Shingles are 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_chunks

SHARE, SHINGLE = 0.8, 5
_BUCKETS = 1 << 22
#: Counts of this many buckets travel as one row, in as few bytes each as they need.
_SLICE = 1 << 12
_BITS = 1 << 24
_CHUNK = 4 << 20
_EDGES = ["a", "b"]


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The XXH64 (seed 42) of each shingle of a text by place, repeats included.

    A-Z are lower-cased; words are runs without ASCII white space; fewer words
    than ``shingle`` make one shingle; no word (null, empty, blank) makes none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    parts = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, parts), repeat(42)), np.uint64, max(1, len(words) - shingle + 1))


def texts_in_chunks(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[np.ndarray], np.ndarray]]:
    """Pieces of the rows with each text's shingle hashes, its sorted set of them, and the set's name."""
    for b in text_chunks(batches, "text", _CHUNK):
        hashes = [shingle_hashes(t, shingle) for t in b.column("text").to_pylist()]
        sets = [np.unique(h) for h in hashes]
        yield b, hashes, sets, np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)


def parity_bits(hashes: np.ndarray) -> bytes:
    """For each of 2**k cells, at least two a hash and at least 64, whether a set has an odd number of hashes in it."""
    cells = max(64, 1 << (2 * len(hashes) - 1).bit_length()) if len(hashes) else 64
    odd = np.bincount((hashes & np.uint64(cells - 1)).astype(np.int64), minlength=cells).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").tobytes()


def may_be_similar(pairs: DataFrame, nodes: DataFrame, share: float) -> DataFrame:
    """The pairs(a, b) of sets that nodes(key, n, bits) do not rule out.

    Each cell in which the parities of two sets differ holds a hash of only one of them, so few bytes bound what
    both can have in common. The larger set's cells are folded to the number of the smaller one's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y, total in zip(batch.column("x"), batch.column("y"), (batch.column("nx").to_numpy() + batch.column("ny").to_numpy()).tolist()):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                k = min(len(x), len(y))
                x, y = (np.bitwise_xor.reduce(z.reshape(-1, k)) if len(z) > k else z for z in (x, y))
                most = (total - int(np.bitwise_count(x ^ y).sum())) / 2
                ok.append(most * (1 + share) >= share * total - 1e-6)
            yield batch.select(_EDGES).filter(pa.array(ok, pa.bool_()))

    side = lambda key, bits, n: nodes.select(F.col("key").alias(key), F.col("bits").alias(bits), F.col("n").cast("long").alias(n))
    return pairs.join(side("a", "x", "nx"), "a").join(side("b", "y", "ny"), "b").select("a", "b", "x", "y", "nx", "ny").mapInArrow(run, "a long, b long")


def _common(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of shingles that stand in more texts than chance gives, and in how many of all texts; only the order of shingles depends on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_BUCKETS, np.int64)
        for _, _, sets, _ in texts_in_chunks(batches, shingle):
            total += np.bincount((np.concatenate(sets) % np.uint64(_BUCKETS)).astype(np.int64), minlength=_BUCKETS)
        slices = total.reshape(-1, _SLICE)
        for i in np.flatnonzero(slices.any(1)).tolist():
            kind = np.min_scalar_type(int(slices[i].max()))
            yield pa.record_batch({"slice": pa.array([i], pa.int32()), "n": pa.array([slices[i].astype(kind).tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for i, n in zip(b.column("slice").to_pylist(), b.column("n").to_pylist()):
                n = np.frombuffer(n, f"u{len(n) // _SLICE}")
                found[i] = found[i] + n if i in found else n.astype(np.int64)
        for i, n in found.items():
            at = np.flatnonzero(n)
            yield pa.record_batch({"bucket": pa.array((at + i * _SLICE).astype(np.int32)), "n": pa.array(n[at])})

    sliced = docs.select("text").mapInArrow(run, "slice int, n binary")
    counts = materialize(sliced.repartition("slice").mapInArrow(add, "bucket int, n long"), "common")
    mean = (counts.agg(F.sum("n")).first()[0] or 0) / _BUCKETS
    found = counts.where(F.col("n") > 1 + mean + 3 * math.sqrt(mean)).toArrow().sort_by("bucket")
    return found.column("bucket").to_numpy().astype(np.int64), found.column("n").to_numpy()


def _prefixes(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], share: float, shingle: int) -> DataFrame:
    """(token, key, n, pos): the shingles of each text's prefix and their places in the order."""
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, counts = sent.value
        for _, _, sets, keys in texts_in_chunks(batches, shingle):
            tokens = []
            for h in sets:
                if len(buckets):
                    own = (h % np.uint64(_BUCKETS)).astype(np.int64)
                    place = np.minimum(np.searchsorted(buckets, own), len(buckets) - 1)
                    h = h[np.argsort(np.where(buckets[place] == own, counts[place], 0), kind="stable")]
                tokens.append(h[: len(h) - math.ceil(share * len(h) - 1e-9) + 1])
            size = np.array([len(t) for t in tokens], np.int64)
            pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            n = np.repeat(np.array([len(h) for h in sets], np.int32), size)
            yield pa.record_batch({"token": pa.array(np.concatenate(tokens).view(np.int64)), "key": pa.array(np.repeat(keys, size)), "n": pa.array(n), "pos": pa.array(pos.astype(np.int32))})

    return docs.select("text").mapInArrow(run, "token long, key long, n int, pos int")


def _shared(prefixes: DataFrame) -> DataFrame:
    """The rows whose token is in the prefix of another set too; those of equal sets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, met = ["token", "key", "n", "pos"], None, False

        def rows(cols: list[np.ndarray]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c) for c in cols], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in names]
            if held is not None:
                cols = [np.r_[h, c] for h, c in zip(held, cols)]
            new = np.r_[True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])]
            cols = [c[new] for c in cols]
            same = cols[0][1:] == cols[0][:-1]
            before = np.r_[met, same]
            ok = (before | np.r_[same, False])[:-1]
            yield rows([c[:-1][ok] for c in cols])
            held, met = [c[-1:] for c in cols], before[-1]
        if met:
            yield rows(held)

    return prefixes.repartition("token").sortWithinPartitions("token", "key").mapInArrow(run, "token long, key long, n int, pos int")


def _meet(share: float, first_only: bool):
    """Pairs of rows of a cell that may be similar; with ``first_only`` those of its first row alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by token and cell; pairs of different components that may be similar go on."""
        names = ("token", "cell", "key", "n", "pos", "comp", "side")
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in names]
            if held is not None:
                cols = [np.r_[h, c] for h, c in zip(held, cols)]
            yield from settle(cols, cut := int(np.flatnonzero(np.r_[True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])])[-1]))
            held = [c[cut:] for c in cols]
        if held is not None:
            yield from settle(held, len(held[0]))

    def settle(cols: list[np.ndarray], end: int) -> Iterator[pa.RecordBatch]:
        if not end:
            return
        token, cell, key, n, pos, comp, side = (c[:end] for c in cols)
        n, pos = n.astype(np.int64), pos.astype(np.int64)
        bounds = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (cell[1:] != cell[:-1])])
        ends = np.r_[bounds[1:], end]
        mixed = np.minimum.reduceat(comp, bounds) != np.maximum.reduceat(comp, bounds)
        found: list[np.ndarray] = []
        many = 0
        for lo, hi in zip(bounds[mixed].tolist(), ends[mixed].tolist()):
            step = max(1, (1 << 20) // (hi - lo))
            for at in range(lo, lo + 1 if first_only else hi, step):
                x, y = slice(at, lo + 1 if first_only else min(hi, at + step)), slice(lo, hi)
                a, b = n[x, None], n[None, y]
                rest = np.minimum(a - pos[x, None], b - pos[None, y])  # what can still be common from the first common token on
                ok = ((key[x, None] < key[None, y]) | first_only) & (comp[x, None] != comp[None, y]) & (rest * (1 + share) >= share * (a + b) - 1e-9)
                ok &= (side[x, None] == 0) | (side[x, None] != side[None, y])
                i, j = np.nonzero(ok)
                found.append(np.sort(np.stack([key[x][i], key[y][j]]), 0))
                many += len(i)
                if many > 1 << 20:
                    yield out(found)
                    found, many = [], 0
        if found:
            yield out(found)

    def out(found: list[np.ndarray]) -> pa.RecordBatch:
        a, b = np.unique(np.concatenate(found, 1), axis=1)
        return pa.record_batch([pa.array(a), pa.array(b)], _EDGES)

    return run


def similar_across(shared: DataFrame, roots: DataFrame, share: float, block: int, first_only: bool = False) -> DataFrame:
    """Candidate pairs (a, b) of sets that may be similar and that roots(node, root) do not connect, from ``shared_prefixes``.

    Tokens of many sets are met in cells of two blocks each. ``first_only`` pairs only the first set of a cell with
    the others, so it makes as many pairs as rows at most: a step that connects large groups before all is compared.
    """
    big = shared.groupBy("token").count().where(F.col("count") > block).select("token", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    rows = shared.join(roots, shared["key"] == roots["node"], "left").join(big, "token", "left").withColumns({"comp": F.coalesce("root", "key"), "blocks": F.coalesce("blocks", F.lit(1))})
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    # the cell of blocks i <= j is i * blocks + j; side tells the blocks apart, and is zero where a block meets itself
    cells = (
        rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("token", (F.least("own", "other").cast("long") * F.col("blocks") + F.greatest("own", "other")).alias("cell"), "key", "n", "pos", "comp",
                F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"))
    )
    return cells.repartition("token", "cell").sortWithinPartitions("token", "cell", "key").mapInArrow(_meet(share, first_only), "a long, b long").distinct()


def verified(pairs: DataFrame, docs: DataFrame, share: float, shingle: int) -> DataFrame:
    """The pairs whose whole sets are similar enough. A bitmap of fixed size keeps most other texts out of the shuffle."""
    pairs = materialize(pairs, "pairs")
    key = pairs.select(F.explode(F.array("a", "b")).alias("key")).select(F.col("key").bitwiseAND(F.lit(_BITS - 1)).alias("at"))
    bit = F.expr("shiftleft(1L, cast(at & 63 as int))")
    words = key.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bitmap = np.zeros(_BITS >> 6, np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, sets, keys in texts_in_chunks(batches, shingle):
            at = keys & (_BITS - 1)
            rows = np.flatnonzero(sent.value[at >> 6] >> (at & 63) & 1)
            yield pa.record_batch({"key": pa.array(keys[rows]), "shingles": pa.array([sets[i].tobytes() for i in rows], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("x"), b.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= share * (len(x) + len(y) - both) - 1e-9)
            yield b.select(_EDGES).filter(pa.array(ok, pa.bool_()))

    sets = materialize(docs.select("text").mapInArrow(pick, "key long, shingles binary").dropDuplicates(["key"]), "sets")
    joined = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def shared_prefixes(docs: DataFrame, share: float, shingle: int) -> DataFrame:
    """The shingles (token, key, n, pos) of all prefixes that several sets have in theirs."""
    return materialize(_shared(_prefixes(docs, _common(docs, shingle), share, shingle)), "shared")
