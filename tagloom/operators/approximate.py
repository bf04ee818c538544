"""Approximate neighbours: inverted cells with product-quantised residuals, then exact order.

A codebook is learned on a bounded sample; every row is indexed by it. A request looks into its nearest cells only, orders their rows by
the codes, and compares the first of them exactly.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import written
from .blocks import HELD, _units, top_k

#: Vectors that a codebook is learned on, at most.
SAMPLE = 20_000
BLOCK_ROWS = 1024


@dataclass
class Codebook:
    """centroids (cells x dim) of unit vectors, and for each of ``parts`` stretches of the residual its codes (parts x codes x dim/parts)."""

    centroids: np.ndarray
    codes: np.ndarray

    def cells(self, unit: np.ndarray, many: int = 1) -> np.ndarray:
        """The nearest cells of each vector, nearest first, equal ones by number."""
        near = np.round(unit @ self.centroids.T - (self.centroids**2).sum(axis=1) / 2, 12)
        return np.argsort(-near, axis=1, kind="stable")[:, :many]

    def encode(self, unit: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = (unit - self.centroids[cell]).reshape(len(unit), len(self.codes), -1)
        return np.stack([_nearest(rest[:, m], c) for m, c in enumerate(self.codes)], axis=1).astype("u1")


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k-means from k different rows; a centre that loses all its rows stays."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        at = _nearest(x, centres)
        n = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _usable(df: DataFrame, key: str, dim: int) -> DataFrame:
    vec = F.col("vec").cast("array<double>")
    return df.where(F.col(key).isNotNull() & (F.size("vec") == dim)).select(F.col(key).cast("long").alias("id"), vec.alias("vec"))


def learn(items: DataFrame, dim: int, cells: int = 64, parts: int = 16, codes: int = 64, sample: int = SAMPLE, rounds: int = 12, seed: int = 11) -> Codebook:
    """A codebook of at most ``sample`` vectors, those of the smallest hashes of item_id; the residuals' codes are at most 256 a part."""
    rows = _usable(items, "item_id", dim).orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    unit, bad = _units(rows.column("vec").combine_chunks(), dim) if rows.num_rows else (np.zeros((0, dim)), np.zeros(0, bool))
    x, rng = unit[~bad], np.random.default_rng(seed)
    if not len(x):
        x = np.eye(dim)[:1]
    centroids = _means(x, cells, rounds, rng)
    rest = (x - centroids[_nearest(x, centroids)]).reshape(len(x), parts, -1)
    return Codebook(centroids, np.stack([_means(rest[:, m], codes, rounds, rng) for m in range(parts)]))


def _placed(df: DataFrame, key: str, book: Codebook, many: int, coded: bool) -> DataFrame:
    """Blocks (cell, ids, data) of df's rows by cell: data holds their codes, or their unit vectors."""
    dim = book.centroids.shape[1]
    sent = df.sparkSession.sparkContext.broadcast(book)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, bad = _units(batch.column("vec"), dim)
            unit, ids = unit[~bad], batch.column("id").to_numpy()[~bad]
            cell = sent.value.cells(unit, many)
            data = sent.value.encode(unit, cell[:, 0]) if coded else unit
            yield pa.RecordBatch.from_arrays([pa.array(cell.ravel().astype("i4")), pa.array(np.repeat(ids, cell.shape[1])), pa.array([d.tobytes() for d in np.repeat(data, cell.shape[1], axis=0)], pa.binary())], ["cell", "id", "data"])

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            for lo, hi in ((x, min(x + BLOCK_ROWS, b)) for a, b in zip(cuts, cuts[1:]) for x in range(a, b, BLOCK_ROWS)):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([pa.array([cells[lo]], pa.int32()), pa.array([part.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([b"".join(part.column("data").to_pylist())], pa.binary())], ["cell", "ids", "data"])

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _usable(df, key, dim).mapInArrow(assign, "cell int, id long, data binary").repartitionByRange(n, "cell", "id").sortWithinPartitions("cell", "id")
    return written(rows.mapInArrow(pack, "cell int, ids array<long>, data binary"), "cells")


def index(items: DataFrame, book: Codebook) -> DataFrame:
    """Every usable row of items(item_id, vec), in blocks by cell, as codes."""
    return _placed(items, "item_id", book, 1, True)


def cell_top_k(requests: DataFrame, items: DataFrame, centroids: np.ndarray, k: int, probes: int) -> DataFrame:
    """As ``blocks.top_k`` without filters, over all items of each request's ``probes`` nearest cells; in their exact order, none is left out by its code."""
    dim = centroids.shape[1]
    sent = requests.sparkSession.sparkContext.broadcast(Codebook(centroids, np.zeros((1, 1, dim))))

    def placed(df: DataFrame, key: str, many: int) -> DataFrame:
        def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                unit, bad = _units(batch.column("vec"), dim)
                cells = sent.value.cells(unit, many).tolist()
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), pa.array([[] if b else c for c, b in zip(cells, bad)], pa.list_(pa.int32()))], ["id", "vec", "cells"])

        rows = _usable(df, key, dim).mapInArrow(assign, "id long, vec array<double>, cells array<int>")
        return rows.select(F.col("id").alias(key), "vec", F.explode("cells").alias("cell"))

    # a cell stands as amount and as audience: blocks lie in the order of the first, and only those that share the second meet
    cell, name = F.col("cell").cast("double"), F.col("cell").cast("string")
    asked = placed(requests, "request_id", probes).select("request_id", "vec", cell.alias("budget"), name.alias("wanted"))
    return top_k(asked, placed(items, "item_id", 1).select("item_id", "vec", cell.alias("price"), name.alias("gender")), k)


def _pairs(requests: DataFrame, cells: DataFrame, book: Codebook, probes: int) -> DataFrame:
    asked = _placed(requests, "request_id", book, probes, False)
    return cells.join(asked.select("cell", F.col("ids").alias("q_ids"), F.col("data").alias("q_data")), "cell")


def compared(requests: DataFrame, cells: DataFrame, book: Codebook, probes: int) -> int:
    """How many pairs of request and item a search with so many probes looks at."""
    return _pairs(requests, cells, book, probes).agg(F.sum(F.size("ids").cast("long") * F.size("q_ids"))).first()[0] or 0


def approximate_top_k(requests: DataFrame, items: DataFrame, cells: DataFrame, book: Codebook, k: int, probes: int = 8, again: int = 200) -> DataFrame:
    """As ``blocks.top_k`` without filters, from the ``probes`` nearest cells: of their rows the ``again`` nearest by code are put in exact order.

    Vectors of another length than the codebook's, null, zero and not finite ones are no neighbours.
    """
    parts, dim = len(book.codes), book.centroids.shape[1]
    sent = requests.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for request, (item, near) in best.items():
                yield pa.RecordBatch.from_pydict({"request_id": np.full(len(item), request), "item_id": item, "near": near})
            best.clear()

        for batch in batches:
            for row in batch.to_pylist():
                ids, code = np.array(row["ids"]), np.frombuffer(row["data"], "u1").reshape(-1, parts)
                q = np.frombuffer(row["q_data"]).reshape(-1, dim)
                near = np.repeat((q @ sent.value.centroids[row["cell"]])[:, None], len(ids), axis=1)
                for m, (stretch, codes) in enumerate(zip(np.split(q, parts, axis=1), sent.value.codes)):
                    near += (stretch @ codes.T)[:, code[:, m]]
                for request, own in zip(row["q_ids"], near):
                    item = ids
                    if request in best:
                        item, own = np.r_[best[request][0], item], np.r_[best[request][1], own]
                    if len(item) > again:
                        at = np.argpartition(own, -again)[-again:]
                        item, own = item[at], own[at]
                    best[request] = item, own
                if len(best) > HELD:
                    yield from flush()
        yield from flush()

    found = _pairs(requests, cells, book, probes).mapInArrow(run, "request_id long, item_id long, near double")
    by = Window.partitionBy("request_id")
    first = found.withColumn("n", F.row_number().over(by.orderBy(F.desc("near"), "item_id"))).where(F.col("n") <= again)
    both = first.join(_usable(requests, "request_id", dim).select(F.col("id").alias("request_id"), F.col("vec").alias("q")), "request_id").join(_usable(items, "item_id", dim).select(F.col("id").alias("item_id"), "vec"), "item_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    exact = both.select("request_id", "item_id", F.round(dot(F.col("q"), F.col("vec")) / F.sqrt(dot(F.col("q"), F.col("q"))) / F.sqrt(dot(F.col("vec"), F.col("vec"))), 12).alias("sim"))
    return exact.withColumn("rank", F.row_number().over(by.orderBy(F.desc("sim"), "item_id"))).where(F.col("rank") <= k)
