"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits are cut into two halves. Two fingerprints that differ in
at most three bits agree, in one half, up to one bit. In each half the anchors
are the words of a covering code: the perfect (31, 26) Hamming code on 31 bits
times the free last bit, with covering radius one. A fingerprint lives at its
nearest anchor and is replicated to every anchor within radius plus threshold
(two bits), at most 17 a half, so a partner's home is always among them. Cells,
one for each anchor, are compared independently; the homes of a large cell are
dealt into blocks. A cell emits a spanning forest of its links, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import component_ids, connected_components, join_skewed, materialize, spanning_forest, text_chunks
from .jaccard import SHARE, SHINGLE, may_be_similar, parity_bits, shared_prefixes, shingle_hashes, similar_across, texts_in_chunks, verified

BLOCK = 4096
_SLICE = 1 << 16


def majority_bits(hashes: np.ndarray) -> int:
    """Bit i is one if it is set in over half of the 64-bit hashes; without hashes zero."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), _SLICE):
        h = np.ascontiguousarray(hashes[lo : lo + _SLICE], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Fingerprint of one text from its shingle hashes, repeats included; no word (null, empty, blank) gives zero."""
    return majority_bits(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp long) for each row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, "text"):
            fps = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "fp": pa.array(fps.view(np.int64))})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _flips() -> list[np.ndarray]:
    """For each syndrome, the flips of a 32-bit half that lead to an anchor; the first leads home."""
    out = []
    for s in range(32):
        near = [0] if s == 0 else [1 << (s - 1)]
        pairs = [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < i ^ s] if s else []
        out.append(np.array([*near, *pairs, near[0] | (1 << 31)], np.uint64))
    return out


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, index into fps, at home) for every anchor that the covering asks for."""
    flips = _flips()
    masks = [sum(1 << i for i in range(31) if (i + 1) >> k & 1) for k in range(5)]
    key, at, home = [], [], []
    for half in (0, 1):
        part = (fps >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        syndrome = sum((np.bitwise_count(part & np.uint64(m)) & 1).astype(np.int64) << k for k, m in enumerate(masks))
        for s in range(32):
            rows = np.flatnonzero(syndrome == s)
            f = flips[s]
            key.append((part[rows][:, None] ^ f[None, :] | np.uint64(half << 32)).ravel())
            at.append(np.repeat(rows, len(f)))
            home.append(np.tile(np.arange(len(f)) == 0, len(rows)))
    return np.concatenate(key).view(np.int64), np.concatenate(at), np.concatenate(home)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column("fp").to_numpy()
        key, at, home = anchors(fps.view(np.uint64))
        yield pa.record_batch({"anchor": pa.array(key), "fp": pa.array(fps[at]), "home": pa.array(home)})


def _compare(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor, block and home first; only a cell's homes are held back."""
        held: tuple[tuple[int, int], np.ndarray] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            anchor, block, fp = (b.column(c).to_numpy() for c in ("anchor", "block", "fp"))
            fp = fp.view(np.uint64)  # bits of negative numbers are counted in their absolute value
            home = b.column("home").to_numpy(zero_copy_only=False)
            if held is not None:
                (a, k), h = held
                if (anchor[0], block[0]) == (a, k):
                    anchor, block = np.r_[np.full(len(h), a), anchor], np.r_[np.full(len(h), k), block]
                    fp, home = np.r_[h, fp], np.r_[np.ones(len(h), bool), home]
            bounds = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1])])
            ends = np.r_[bounds[1:], len(fp)]
            held = ((anchor[-1], block[-1]), fp[bounds[-1] : ends[-1]][home[bounds[-1] : ends[-1]]])
            homes = np.add.reduceat(home.astype(np.int64), bounds)
            us, vs = [], []
            one = np.flatnonzero((homes == 1) & (ends - bounds > 1))
            if len(one):
                size = ends[one] - bounds[one]
                rows = np.repeat(bounds[one] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
                us.append(np.repeat(fp[bounds[one]], size))
                vs.append(fp[rows])
                hit = np.bitwise_count(us[-1] ^ vs[-1]) <= threshold
                us[-1], vs[-1] = us[-1][hit], vs[-1][hit]
            for i in np.flatnonzero((homes > 1)):
                h, r = fp[bounds[i] : bounds[i] + homes[i]], fp[bounds[i] : ends[i]]
                step = max(1, (1 << 21) // len(h))
                for lo in range(0, len(r), step):
                    part = r[lo : lo + step]
                    x, y = np.nonzero(np.bitwise_count(h[:, None] ^ part[None, :]) <= threshold)
                    u, v = spanning_forest(h[x], part[y])
                    us.append(u)
                    vs.append(v)
            if us:
                u, v = np.concatenate(us), np.concatenate(vs)
                keep = u != v
                yield pa.record_batch({"a": pa.array(u[keep].view(np.int64)), "b": pa.array(v[keep].view(np.int64))})

    return run


def links(fps: DataFrame, threshold: int = 3, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints of fps(fp) within ``threshold`` bits."""
    if not 0 <= threshold <= 3:
        raise ValueError("the covering holds for thresholds up to 3")
    cells = fps.select("fp").mapInArrow(_replicate, "anchor long, fp long, home boolean")
    big = (
        cells.where("home").groupBy("anchor").count().where(F.col("count") > block)
        .select("anchor", F.ceil(F.col("count") / block).alias("blocks"))
    )
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    split = (
        cells.join(big, "anchor", "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("home", F.col("home") & (F.col("block") == own))
        .select("anchor", F.col("block").cast("int").alias("block"), "fp", "home")
    )
    dealt = split.repartition("anchor", "block").sortWithinPartitions("anchor", "block", F.desc("home"))
    return dealt.mapInArrow(_compare(threshold), "a long, b long")


def simhash_components(docs: DataFrame, threshold: int = 3, shingle: int = 3, block: int = BLOCK) -> DataFrame:
    """One row per row of docs(doc_id, text, ..): doc_id, fingerprint, component_id.

    Documents whose fingerprints differ in ``threshold`` bits or fewer are linked;
    component_id is the smallest doc_id reachable. Null and blank texts have
    fingerprint zero and are linked like any other. A null doc_id takes part but is
    never a component_id, unless the whole component has none. Repeated rows stay,
    with equal results. Other columns are ignored; an empty table gives no rows.
    """
    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    nodes = materialize(prints.groupBy(F.col("fp").alias("key")).agg(F.min("doc_id").alias("id"), F.count("*").alias("w")), "nodes")
    edges = links(nodes.select(F.col("key").alias("fp")), threshold, block)
    named = materialize(component_ids(nodes.select("key", "id"), edges).withColumnRenamed("key", "fp"), "named")
    return join_skewed(prints, named, nodes.select(F.col("key").alias("fp"), "w"), ["fp"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _similar(docs: DataFrame, share: float, shingle: int, threshold: int, block: int) -> DataFrame:
    """(doc_id, of_text, component_id) for each row; ``of_text`` hashes the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, hashes, sets, keys in texts_in_chunks(batches, shingle):
            fps = np.array([majority_bits(h) for h in hashes], np.uint64)
            yield pa.record_batch({
                "doc_id": b.column("doc_id"), "of_text": b.column("of_text"), "key": pa.array(keys), "fp": pa.array(fps.view(np.int64)),
                "n": pa.array([len(s) for s in sets], pa.int32()), "bits": pa.array([parity_bits(s) for s in sets], pa.binary()),
            })

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("of_text"), "text")
    rows = materialize(named.mapInArrow(run, "doc_id long, of_text long, key long, fp long, n int, bits binary"), "keys")
    nodes = materialize(rows.groupBy("key").agg(F.min("doc_id").alias("id"), F.min("fp").alias("fp"), F.first("n").alias("n"), F.first("bits").alias("bits")), "nodes")
    first = materialize(nodes.groupBy("fp").agg(F.min("key").alias("first")), "first")
    edges = links(first.select("fp"), threshold, block)
    between = edges.join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    within = nodes.join(first, "fp").where("key <> first").select(F.col("first").alias("x"), F.col("key").alias("y"))
    pairs = between.select("x", "y").unionByName(within).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    near = materialize(verified(may_be_similar(pairs, nodes, share), docs, share, shingle), "near")
    shared = shared_prefixes(docs, share, shingle)
    for first_only in (True, False):
        missing = similar_across(shared, connected_components(near), share, block, first_only)
        near = near.unionByName(materialize(verified(may_be_similar(missing, nodes, share), docs, share, shingle), "far"))
    return rows.select("doc_id", "of_text", "key").join(component_ids(nodes.select("key", "id"), near), "key").drop("key")


def similar_components(docs: DataFrame, share: float = SHARE, shingle: int = SHINGLE, threshold: int = 3, block: int = BLOCK) -> DataFrame:
    """(doc_id, component_id) for each row: texts of Jaccard similarity ``share`` or more are linked.

    The anchors find most links: fingerprints of the same shingles within ``threshold`` bits are candidates, each verified on
    both whole sets. Texts may be that similar and yet differ in more bits, so a prefix filter then finds what is still missing
    between components, and nothing is lost. component_id is the smallest doc_id reachable. Null and blank texts
    equal each other and nothing else. A null doc_id takes part but is never a component_id, unless the whole component
    has none. Repeated rows stay; other columns are ignored; an empty table gives no rows.
    """
    return _similar(docs, share, shingle, threshold, block).drop("of_text")


def drop_near_duplicates(docs: DataFrame, share: float = SHARE, shingle: int = SHINGLE) -> DataFrame:
    """Keep of each component the rows of the smallest doc_id; all columns stay.

    Rows that share doc_id and text stay or go together, and rows without a doc_id stay. Two different texts under one
    doc_id are judged apart: one goes only if it is similar itself to a text of a smaller doc_id, directly or by a chain.
    """
    found = _similar(docs, share, shingle, 3, BLOCK)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("id"), "of_text").distinct()
    return docs.join(gone, (docs["doc_id"] == gone["id"]) & (F.xxhash64(docs["text"]) == gone["of_text"]), "left_anti")
