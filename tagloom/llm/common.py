"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import delete_at_exit

_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL_DIRS[app]


def materialize(df: DataFrame, label: str, *by: str) -> DataFrame:
    """Write ``df`` to the shared folder, apart by the columns ``by``, and read it back: lineage is cut and survives lost executors.

    The folder goes when the driver ends: until then frames may read it again.
    """
    folder = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    delete_at_exit(df.sparkSession, folder)
    path = f"{folder}/{label}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    """The cluster's own number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a piece has about ``limit`` bytes of text, or one row; at the end free memory goes back."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // limit
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        for lo, hi in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(lo, hi - lo)
    pa.default_memory_pool().release_unused()


def spanning_forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) that connect what u-v connect."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def connected_components(edges: DataFrame) -> DataFrame:
    """Label every node of ``edges(a long, b long)`` with its component's smallest node.

    Alternates the large-star and small-star steps until the edge set is stable;
    each round is written to the shared folder. Nodes without edges do not occur
    in the result (node, root). Loops and repeated edges are ignored.
    """

    def signature(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    seen = signature(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e = materialize(e, "large")
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x"))
        e = materialize(e.select("x.u", F.col("x.m").alias("v")).where("u <> v").distinct(), "small")
        new = signature(e)
        if new == seen:
            break
        seen = new
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )


def component_ids(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, component_id): the smallest ``id`` of all nodes(key, id) that edges(a, b) connect."""
    roots = connected_components(edges)
    joined = nodes.join(roots, nodes["key"] == roots["node"], "left").select(
        "key", "id", F.coalesce("root", "key").alias("root")
    )
    lowest = joined.groupBy("root").agg(F.min("id").alias("component_id"))
    return joined.join(lowest, "root").select("key", "component_id")


def join_skewed(rows: DataFrame, names: DataFrame, counted: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` joined with ``names``, one row a key, by the columns ``by``; counted(by.., w) holds how many rows have each key.

    Keys with over a thousandth of all rows, of which there are a thousand at most, are
    broadcast; no key of the rows that are shuffled is hot. Null keys join with nothing.
    """
    total = counted.agg(F.sum("w")).first()[0] or 0
    hot = F.broadcast(counted.where(F.col("w") * 1000 > F.lit(total)).select(*by))
    few, rest = names.join(hot, by, "left_semi"), names.join(hot, by, "left_anti")
    return rows.join(F.broadcast(few), by).unionByName(rows.join(hot, by, "left_anti").join(rest, by))
