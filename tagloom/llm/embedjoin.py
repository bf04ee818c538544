"""Embedding near-duplicates by an exact metric range join.

Angles between vectors are a metric. Pivots are chosen far apart from a bounded
sample; each vector lives in the cell of its nearest pivot. By the triangle
inequality a vector x can have a partner in the cell of pivot p only if
angle(x, p) <= r + t and angle(x, p) <= angle(x, own pivot) + 2 t, with r the
cell's largest angle and t the angle of the threshold; it is replicated to those
cells alone, and a pair of cells is compared in one of the two. Cells join
independently; the members of a large cell are dealt into blocks. A block counts
links and emits a spanning forest, not all pairs. Equal vectors are joined once:
they are grouped by their entries, and each different vector gets a number of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import component_ids, join_skewed, materialize, spanning_forest

SAMPLE = 4096
#: Members of a cell beyond this are dealt into further blocks.
CELL = 4096
#: Bound on the pivots that a task holds; larger tables get larger cells, in more blocks.
MAX_PIVOTS = 1024
_SLACK = 1e-6


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, by their largest component first: no overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1.0, 1.0))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first traversal of unit vectors."""
    chosen = [0]
    gap = _angles(sample, sample[:1])[:, 0]
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, _angles(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def _owned(home: np.ndarray, cells: int) -> np.ndarray:
    """Whether cell j compares its members with those of cell ``home``: one of each two does."""
    ahead = (np.arange(cells)[None, :] - home[:, None]) % cells
    tie = (2 * ahead == cells) & (np.arange(cells)[None, :] < home[:, None])
    return (ahead > 0) & (2 * ahead <= cells) & ~tie


def pivots_for(size: int) -> int:
    """A quarter of the square root of the number of different vectors, and one, up to ``MAX_PIVOTS``."""
    return min(MAX_PIVOTS, math.isqrt(size) // 4 + 1)


def _links_of(reps: DataFrame, dim: int, threshold: float, cell: int, pivots: int | None) -> DataFrame:
    """Rows (a, b, n): n null for an edge a-b, else n links more for node a; reps(key, k1, k2, vec array<double>, w)."""
    count = pivots or pivots_for(reps.count())
    drawn = reps.orderBy("k1", "k2").limit(SAMPLE).select("vec").toPandas()["vec"]
    pivots = choose_pivots(_unit(np.array([np.asarray(v, float) for v in drawn]).reshape(-1, dim)), count)
    reach = math.acos(threshold) + _SLACK

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                a = _angles(_unit(_matrix(b.column("vec"), dim)), pivots)
                yield pa.record_batch({"cell": pa.array(a.argmin(1).astype(np.int32)), "r": pa.array(a.min(1))})

    known = reps.select("vec").mapInArrow(measure, "cell int, r double").groupBy("cell").agg(F.max("r").alias("r"), F.count("*").alias("n")).collect()
    radius, blocks = np.full(len(pivots), -10.0), np.ones(len(pivots), np.int64)
    for row in known:
        radius[row.cell], blocks[row.cell] = row.r, -(-row.n // cell)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                b = whole.slice(lo, 1024)
                key = b.column("key").to_numpy()
                angle = _angles(_unit(_matrix(b.column("vec"), dim)), pivots)
                home = angle.argmin(1)
                own = key.astype(np.uint64) % blocks[home].astype(np.uint64)
                near = (angle <= radius[None, :] + reach) & (angle <= angle.min(1, keepdims=True) + 2 * reach) & _owned(home, len(pivots))
                at, to = np.nonzero(near)
                # in the own cell: at home in one block, a guest in the blocks after it
                at, to = np.r_[np.arange(len(key)), at], np.r_[home, to]
                first = np.r_[own.astype(np.int64), np.zeros(len(at) - len(key), np.int64)]
                span = blocks[to] - first
                rows = np.repeat(np.arange(len(at)), span)
                block = np.arange(len(rows)) - np.repeat(np.cumsum(span) - span, span) + first[rows]
                is_home = (rows < len(key)) & (block == first[rows])
                for cut in range(0, len(rows), 8192):
                    part = rows[cut : cut + 8192]
                    source = b.take(pa.array(at[part]))
                    yield pa.record_batch({
                        "cell": pa.array(to[part].astype(np.int32)), "block": pa.array(block[cut : cut + 8192].astype(np.int32)), "home": pa.array(is_home[cut : cut + 8192]),
                        "key": source.column("key"), "w": source.column("w"), "vec": source.column("vec"),
                    })

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by cell and block, homes first; only a block's homes are held."""
        current, held = None, None

        def emit(u, v, links) -> pa.RecordBatch:
            node = np.concatenate([x for x, _ in links]) if links else np.zeros(0, np.int64)
            n = np.concatenate([x for _, x in links]) if links else np.zeros(0, np.int64)
            a, b = np.r_[u, node].astype(np.int64), np.r_[v, np.zeros(len(node), np.int64)].astype(np.int64)
            n = np.r_[np.zeros(len(u), np.int64), n].astype(np.int64)
            return pa.record_batch({"a": pa.array(a), "b": pa.array(b), "n": pa.array(n, mask=np.arange(len(n)) < len(u))})

        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                b = whole.slice(lo, 2048)
                cells, block = b.column("cell").to_numpy(), b.column("block").to_numpy()
                key, w = b.column("key").to_numpy(), b.column("w").to_numpy()
                home = b.column("home").to_numpy(zero_copy_only=False)
                x = _unit(_matrix(b.column("vec"), dim))
                bounds = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]) | (block[1:] != block[:-1])])
                us, vs, links = [], [], []
                for s, e in zip(bounds, [*bounds[1:], len(key)]):
                    if (cells[s], block[s]) != current:
                        current, held = (cells[s], block[s]), (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, dim)))
                    hk, hw, hx = held
                    h = int(home[s:e].sum())
                    nk, nw, nx = np.r_[hk, key[s : s + h]], np.r_[hw, w[s : s + h]], np.r_[hx, x[s : s + h]]
                    held = (nk, nw, nx)
                    if not len(nk):
                        continue
                    score = x[s:e] @ nx.T
                    if h:  # a pair of two homes counts once, when the later one comes
                        score[:h, len(hk) :][np.triu_indices(h)] = -2.0
                    i, j = np.nonzero(score >= threshold)
                    if not len(i):
                        continue
                    links.append((key[s:e][i], nw[j]))
                    links.append((nk[j], w[s:e][i]))
                    u, v = spanning_forest(key[s:e][i], nk[j])
                    us.append(u)
                    vs.append(v)
                if us:
                    node, at = np.unique(np.concatenate([k for k, _ in links]), return_inverse=True)
                    n = np.bincount(at, np.concatenate([n for _, n in links])).astype(np.int64)
                    yield emit(np.concatenate(us), np.concatenate(vs), [(node, n)])

    dealt = reps.select("key", "w", "vec").mapInArrow(deal, "cell int, block int, home boolean, key long, w long, vec array<double>")
    together = dealt.repartition("cell", "block").sortWithinPartitions("cell", "block", F.desc("home"))
    return together.mapInArrow(join, "a long, b long, n long")


def embedding_components(vectors: DataFrame, threshold: float = 0.9, cell: int = CELL, pivots: int | None = None) -> DataFrame:
    """One row per row of vectors(vec_id, embedding, ..): vec_id, n_links, component_id, kept.

    Cosines are computed in double precision. Vectors that are null, empty or zero or hold null
    or non-finite components link with nothing, nor do vectors of different lengths. n_links
    counts other rows, so repeated rows link with each other. component_id is the smallest
    vec_id reachable; a row without vec_id takes part but names no component. Labels and
    other columns are ignored; an empty table gives no rows. ``cell`` and ``pivots`` (by
    default ``pivots_for``) divide the work and change no result.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.coalesce(F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    name = [F.xxhash64("vec").alias("k1"), F.xxhash64(F.lit(1), "vec").alias("k2")]
    different = rows.where(valid).groupBy("vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("w"))
    reps = materialize(different.select(F.monotonically_increasing_id().alias("key"), *name, "vec", "id", "w"), "vectors")
    found = None
    for (dim,) in sorted(tuple(r) for r in reps.select(F.size("vec")).distinct().collect()):
        part = _links_of(reps.where(F.size("vec") == dim), dim, threshold, cell, pivots)
        found = part if found is None else found.unionByName(part)
    spark = vectors.sparkSession
    found = spark.createDataFrame([], "a long, b long, n long") if found is None else materialize(found, "links")
    named = component_ids(reps.select("key", "id"), found.where("n is null").select("a", "b"))
    degree = found.where("n is not null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))
    links = (F.coalesce("n", F.lit(0)) + F.col("w") - 1).cast("long").alias("n_links")
    nodes = materialize(reps.drop("vec").join(degree, "key", "left").join(named, "key").select("k1", "k2", links, "component_id"), "nodes")
    linked = join_skewed(rows.where(valid).select("vec_id", *name), nodes, reps.select("k1", "k2", "w"), ["k1", "k2"])
    alone = rows.where(~valid).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.drop("k1", "k2").unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
