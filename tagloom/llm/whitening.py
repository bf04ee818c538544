"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

The centred vectors are the rows of a matrix Y that stays distributed, in blocks of a written
table. Each step multiplies alternately: u = Yw in the tasks, row by row, and Yᵀu added up over
all of them. The left vectors u are never stored: each is Yw for a w of the vectors' dimension,
and the products with earlier ones, which full reorthogonalisation takes off, follow from
Yᵀu_i, which earlier steps have summed. The SVD of the small bidiagonal matrix gives the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

COMPONENTS = 4
#: Vectors of a block.
_BLOCK_ROWS = 512
#: Singular values under this share of the largest count as zero.
_ZERO = 1e-12
_SAFE = float(1 << 62)


def _usable(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, x) of each row whose vector is whole and finite: x = floor(scale * c), as long, zeros after a shorter vector's end."""
    c = F.col("embedding").cast("array<double>")
    x = F.transform(c, lambda e: F.floor(e * scale).cast("long"))
    found = vectors.select("vec_id", c.alias("c"), x.alias("x")).where(_usable(F.col("c"))).select("vec_id", "x")
    width = found.agg(F.max(F.size("x"))).first()[0] or 0
    return found.select("vec_id", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))).alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _blocks(x: DataFrame, width: int) -> DataFrame:
    """The rows of x as blocks of 64-bit integers."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK_ROWS):
                m = _matrix(batch.column("x").slice(at, _BLOCK_ROWS), width)
                yield pa.RecordBatch.from_pydict({"block": [m.astype("<i8").tobytes()]})

    return x.mapInArrow(pack, "block binary")


def _read(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for b in batch.column("block"):
            yield np.frombuffer(b.as_buffer(), "<i8").reshape(-1, width)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n, by exact integers where they fit."""
    s = np.array([float(v) for v in sums])
    if n * max(np.abs(x.astype(float)).max(initial=0), 1.0) + np.abs(s).max(initial=0) < _SAFE:
        return (x * n - np.array(sums, "i8")) / n
    return x - s / n


def _summed(blocks: DataFrame, width: int, rows: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of part(block), an array of ``rows`` numbers: once a task, then one aggregate."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(rows)
        for x in _read(batches, width):
            total += part(x)
        yield pa.RecordBatch.from_pydict({"j": np.arange(rows, dtype="i4"), "v": total})

    found = blocks.mapInArrow(run, "j int, v double").groupBy("j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(rows)
    for r in found:
        out[r["j"]] = r["v"]
    return out


def _sums(blocks: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of vectors and their exact sums by dimension."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for x in _read(batches, width):
            n += len(x)
            small = np.abs(x.astype(float)).max(initial=0) * len(x) < _SAFE
            total = [a + int(b) for a, b in zip(total, x.sum(axis=0) if small else x.astype(object).sum(axis=0))]
        yield pa.RecordBatch.from_pydict({"j": pa.array(range(width + 1), pa.int32()), "v": [str(v) for v in (*total, n)]})

    rows = blocks.mapInArrow(run, "j int, v string").groupBy("j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    found = {r["j"]: int(r["v"]) for r in rows}
    return found.get(width, 0), [found.get(j, 0) for j in range(width)]


def bidiagonal_components(product: Callable[[np.ndarray], tuple[np.ndarray, float]], width: int, trace: float, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(right singular vectors as columns, singular values), the ``k`` largest that are not zero, of a matrix Y.

    ``product(w)`` gives Yᵀ(Yw) and the square of the norm of Yw; ``trace`` is the sum of Y's squares. Stops when the k
    triplets have no residual left and what the basis has not reached is too small to hold a larger one, at ``width`` steps at most.
    """
    rng = np.random.default_rng(seed)
    right, left, seen = np.zeros((0, width)), np.zeros((0, width)), np.zeros((0, width))
    small = np.zeros((0, 0))
    v = rng.standard_normal(width)
    v /= np.linalg.norm(v)
    beta, scale = 0.0, np.sqrt(trace)
    while len(right) < width:
        right = np.vstack([right, v])
        w = v.copy()
        for _ in range(2):
            w -= (seen @ w) @ left
        z, square = product(w)
        alpha = np.sqrt(max(square, 0.0))
        empty = alpha <= _ZERO * scale
        left = np.vstack([left, np.zeros(width) if empty else w / alpha])
        g = np.zeros(width) if empty else z / alpha
        seen = np.vstack([seen, g])
        steps = len(right)
        grown = np.zeros((steps, steps))
        grown[:-1, :-1] = small
        grown[-1, -1] = 0.0 if empty else alpha
        if steps > 1:
            grown[-2, -1] = beta
        small = grown
        r = g.copy()
        for _ in range(2):
            r -= (right @ r) @ right
        beta = np.linalg.norm(r)
        if beta <= _ZERO * scale:  # the space is closed: go on from a new direction
            beta, r = 0.0, rng.standard_normal(width)
            for _ in range(2):
                r -= (right @ r) @ right
            norm = np.linalg.norm(r)
            if steps == width or norm <= 1e-8:
                break
            v = r / norm
        else:
            v = r / beta
        if steps >= min(k, width):
            p, s, _ = np.linalg.svd(small)
            left_over = trace - float((small**2).sum())
            if beta * np.abs(p[-1, :k]).max() <= 4 * np.finfo(float).eps * s[0] and left_over < 0.5 * s[k - 1] ** 2:
                break
    _, s, q = np.linalg.svd(small)
    keep = [i for i in range(min(k, len(s))) if s[i] > _ZERO * max(s[0], 1e-300) and s[i] > 0]
    components = (q @ right)[keep].T
    return components / np.linalg.norm(components, axis=0), s[keep]


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n*x - S)^2, exact; none where it is beyond a long."""
    s = np.array([float(v) for v in sums])
    rough = n * x.astype(float) - s
    out = []
    fits = (rough**2).sum(axis=1) < _SAFE
    if n * max(np.abs(x.astype(float)).max(initial=0), 1.0) + np.abs(s).max(initial=0) < _SAFE:
        exact = (x * n - np.array(sums, "i8"))[fits]
        values = iter((exact * exact).sum(axis=1).tolist())
        return [next(values) if f else _exact(row, n, sums) for f, row in zip(fits, x)]
    return out + [_exact(row, n, sums) for row in x]


def _exact(row: np.ndarray, n: int, sums: list[int]) -> int | None:
    value = sum((n * int(a) - b) ** 2 for a, b in zip(row, sums))
    return value if value < 1 << 63 else None


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = 256) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each row and component.

    vectors has vec_id and embedding; other columns are not read. Rows whose vector is null, or holds null or
    non-finite entries, are left out; a vector shorter than the longest counts as if zeros followed. The fit is over the distinct integer
    vectors, so repeated rows weigh nothing and get equal values. Components whose variance is zero have no rows: none where all
    vectors are equal, where vectors are empty, or the table is. A deviation beyond a long is null; equal eigenvalues go in any order.
    """
    return_type = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    vec_id = vectors.schema["vec_id"].dataType.simpleString()
    x = materialize(integer_vectors(vectors, scale), "integers")
    width = x.agg(F.max(F.size("x"))).first()[0] or 0
    blocks = materialize(_blocks(x.select("x").distinct(), width), "blocks") if width else None
    n, sums = _sums(blocks, width) if width else (0, [])
    if not n:
        return x.sparkSession.createDataFrame([], f"vec_id {vec_id}, {return_type}")

    def product(w: np.ndarray) -> tuple[np.ndarray, float]:
        def part(b: np.ndarray) -> np.ndarray:
            y = _centred(b, n, sums)
            u = y @ w
            return np.r_[y.T @ u, u @ u]

        found = _summed(blocks, width, width + 1, part)
        return found[:-1], float(found[-1])

    trace = float(_summed(blocks, width, 1, lambda b: np.array([(_centred(b, n, sums) ** 2).sum()]))[0])
    axes, deviations = bidiagonal_components(product, width, trace, components) if trace > 0 else (np.zeros((width, 0)), np.zeros(0))
    k = len(deviations)
    spread = np.sqrt(deviations**2 / n)

    def moments(b: np.ndarray) -> np.ndarray:
        t = _centred(b, n, sums) @ axes / spread
        return np.r_[(t.T @ t).ravel(), t.sum(axis=0)]

    error = 0.0
    if k:
        found = _summed(blocks, width, k * k + k, moments) / n
        mean = found[k * k :]
        error = float(np.abs(found[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())
    explained = deviations**2 / trace if k else deviations

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows if k else 0, 4096):
                piece = batch.slice(at, 4096)
                m = _matrix(piece.column("x"), width)
                t = _centred(m, n, sums) @ axes / spread
                again = np.repeat(np.arange(len(m)), k)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": piece.column("vec_id").take(pa.array(again)), "component": pa.array(np.tile(np.arange(1, k + 1, dtype="i4"), len(m))), "n": pa.array([n] * len(again), pa.int64()),
                    "deviation": pa.array(_deviations(m, n, sums), pa.int64()).take(pa.array(again)), "whitened": t.ravel(), "explained": np.tile(explained, len(m)), "identity_error": pa.array([error] * len(again), pa.float64()),
                })

    return x.mapInArrow(rows, f"vec_id {vec_id}, {return_type}")
