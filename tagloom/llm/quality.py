"""Quality by Bradley-Terry pairwise ranking.

Every labelled good document is preferred to every bad one, and the mean logistic loss over all these
pairs gives the weights of a document score. All labelled documents outside the held-out fold take part. A pair's loss
depends on its two scores alone, so the scores of a kind are counted along the axis of scores, each divided
between the two marks around it, and the pairs are summed by convolution: a Newton step is two passes over the
documents, whatever the number of pairs. The threshold is the exact quantile of the scores at the share of bad documents.
"""

from __future__ import annotations

import math
import operator
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_chunks
from .labelled import fold, known_labels

CUT = 0.3
FOLDS, HELD_OUT = 5, 0
#: Pairs a document that ``test_quality_pair_loss_is_near_its_least`` draws; the fit itself takes all pairs.
PAIRS = 8
BASE = 10
RIDGE = 1e-4
#: Distance of the marks on the axis of scores, and how many of them make a cell of the curvature.
STEP, CELL = 1 / 64, 16
_PLAIN = {ord(c) for c in ".,;:'\"-?()"}
_SYMBOLS = np.array([33 <= c < 127 and not chr(c).isalnum() and c not in _PLAIN for c in range(256)])
_MARKS = np.array([c in _PLAIN for c in range(256)])


def _base(text: str | None) -> list[float]:
    """Shape of a text: sizes, shares of kinds of characters, repetition; no label, id, source or language."""
    raw = (text or "").encode()
    words = raw.split()
    n, m = max(1, len(raw)), max(1, len(words))
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    symbols, marks = float(count[_SYMBOLS].sum()), float(count[_MARKS].sum())
    repeats = sum(map(operator.eq, words, words[1:]))
    packed = len(zlib.compress(raw, 1)) / n if raw else 1.0
    return [
        upper / max(1, upper + lower), min(4.0, symbols / m), min(4.0, marks / m), int(count[48:58].sum()) / n,
        len(set(words)) / m, repeats / m, min(30.0, n / m) / 10, min(1.0, packed), min(1.0, int(count[10]) / m), math.log1p(len(words)) / 10,
    ]


def _widened(base: np.ndarray) -> np.ndarray:
    """The features of texts, one a row: what ``_base`` gives, its roots and its squares."""
    return np.concatenate([base, np.sqrt(base), base * base], axis=1)


def features(text: str | None) -> list[float]:
    """The features of one text."""
    return _widened(np.array([_base(text)]))[0].tolist()


def _rows_of(batch: pa.RecordBatch) -> np.ndarray:
    return _widened(batch.column("f").flatten().to_numpy().reshape(batch.num_rows, BASE))


def _bases_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([_base(t) for t in batch.column("text").to_pylist()], float).reshape(batch.num_rows, BASE)


def _weighted(rows: np.ndarray, weights: Sequence[float]) -> np.ndarray:
    """Scores of rows of features, the same for equal rows wherever they stand."""
    out = np.zeros(len(rows))
    for k, w in enumerate(weights):
        out += rows[:, k] * w
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass(frozen=True)
class QualityModel:
    """Weights of the document score, and the score at which quality begins."""

    weights: tuple[float, ...]
    threshold: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """For rows of features: 0 to 1, rising with the document score, ``CUT`` at the threshold."""
        return _sigmoid(_weighted(rows, self.weights) - self.threshold + math.log(CUT / (1 - CUT)))


def _described(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, f) of every row: what the features of its text are made of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, "text"):
            yield pa.record_batch({"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "f": pa.array(list(_bases_of(b)), pa.list_(pa.float64()))})

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (fold(FOLDS) == HELD_OUT).alias("held_out"))
    return materialize(keyed.mapInArrow(run, "doc_id long, held_out boolean, f array<double>"), "features")


def _across(mass: np.ndarray, kernel: Callable[[np.ndarray], np.ndarray], step: float) -> np.ndarray:
    """For each mark u of an axis the sum over its marks v of mass[v] * kernel((u - v) * step); a second axis of mass goes along."""
    n = len(mass)
    size = 1 << (2 * n).bit_length()
    at = np.arange(size)
    k = np.fft.rfft(kernel(np.where(at < size // 2, at, at - size) * step))
    return np.fft.irfft(np.fft.rfft(mass, size, axis=0) * k.reshape(-1, *[1] * (mass.ndim - 1)), size, axis=0)[:n]


@dataclass(frozen=True)
class _Axis:
    """Scores of known rows under some weights: marks from ``low`` on; of each kind the rows that follow each mark, and their mass at the marks."""

    weights: np.ndarray
    low: float
    step: float
    count: np.ndarray
    mass: np.ndarray

    def loss(self) -> float:
        """The sum of the loss over all pairs."""
        return float(self.mass[1] @ _across(self.mass[0], lambda x: np.logaddexp(0, -x), self.step))

    def cells(self) -> np.ndarray:
        return np.add.reduceat(self.count, np.arange(0, self.count.shape[1], CELL), axis=1)


class _Pairs:
    """The loss over all pairs of a good and a bad row of known(y, f), and its derivatives.

    They are taken by the features over their spread, the root of the mean square of their differences over all pairs.
    """

    def __init__(self, known: DataFrame):
        self.known = known

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows, y = _rows_of(b), b.column("y").to_numpy()
                for kind in np.unique(y):
                    x = rows[y == kind]
                    yield pa.record_batch({
                        "y": pa.array(np.full(x.shape[1], kind, np.int32)), "k": pa.array(np.arange(x.shape[1], dtype=np.int32)), "n": pa.array(np.full(x.shape[1], len(x))),
                        "s": pa.array(x.sum(0)), "q": pa.array((x * x).sum(0)), "low": pa.array(x.min(0)), "high": pa.array(x.max(0)),
                    })

        rows = known.mapInArrow(run, "y int, k int, n long, s double, q double, low double, high double").groupBy("y", "k")
        found = rows.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
        found = found.sort_by([("y", "ascending"), ("k", "ascending")])
        size = len(features(""))
        n, s, q, low, high = (found.column(c).to_numpy().reshape(-1, size) for c in ("n", "s", "q", "low", "high"))
        kinds = found.column("y").to_numpy()[::size]
        self.bad, self.good = (int(n[kinds == y, 0].sum()) for y in (0, 1))
        if not (self.good and self.bad):
            return
        self.low, self.high, self.middle = low.min(0), high.max(0), s.sum(0) / n.sum(0)
        square = (q / n).sum(0) - 2 * (s / n).prod(0)
        varied = (self.low < self.high) & (square > 0)
        self.scale = np.where(varied, 1 / np.sqrt(np.where(varied, square, 1)), 0.0)

    def axis(self, weights: np.ndarray) -> _Axis:
        """One pass: where the scores of the rows are."""
        low = float(np.minimum(weights * self.low, weights * self.high).sum())
        high = float(np.maximum(weights * self.low, weights * self.high).sum())
        step = max(STEP, (high - low) / (1 << 20))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = (_weighted(_rows_of(b), weights) - low) / step
                mark = np.floor(at)
                found, group = np.unique(mark.astype(np.int64) * 2 + b.column("y").to_numpy(), return_inverse=True)
                yield pa.record_batch({"mark": pa.array(found), "n": pa.array(np.bincount(group)), "r": pa.array(np.bincount(group, at - mark))})

        found = self.known.mapInArrow(run, "mark long, n long, r double").groupBy("mark").agg(F.sum("n").alias("n"), F.sum("r").alias("r")).toArrow()
        mark, n, r = (found.column(c).to_numpy() for c in ("mark", "n", "r"))
        at, y = mark // 2, mark % 2
        first = int(at.min())
        count, mass = np.zeros((2, int(at.max()) - first + 1)), np.zeros((2, int(at.max()) - first + 2))
        count[y, at - first] = n
        np.add.at(mass, (y, at - first), n - r)
        np.add.at(mass, (y, at - first + 1), r)
        return _Axis(weights, low + first * step, step, count, mass)

    def derivatives(self, axis: _Axis) -> tuple[np.ndarray, np.ndarray]:
        """One more pass: gradient and curvature of the sum over all pairs; the latter with scores at the middle of their cells."""
        cells, wide = axis.cells(), axis.step * CELL
        bend = lambda x: _sigmoid(x) * _sigmoid(-x)
        slope = np.stack([_across(axis.mass[1], _sigmoid, axis.step), -_across(axis.mass[0], lambda x: _sigmoid(-x), axis.step)])
        curve = np.stack([_across(cells[1], bend, wide), _across(cells[0], bend, wide)])
        size, many = len(self.scale), cells.shape[1]
        sent = self.known.sparkSession.sparkContext.broadcast((slope, curve))
        weights, low, step, last, middle, scale = axis.weights, axis.low, axis.step, axis.count.shape[1] - 1, self.middle, self.scale

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slope, curve = sent.value
            gradient, second, sums = np.zeros(size), np.zeros((size, size)), np.zeros((2, many, size))
            for b in batches:
                rows, y = _rows_of(b), b.column("y").to_numpy()
                at = (_weighted(rows, weights) - low) / step
                mark = np.clip(np.floor(at).astype(np.int64), 0, last)
                rest = at - mark
                z = (rows - middle) * scale
                gradient += (slope[y, mark] * (1 - rest) + slope[y, mark + 1] * rest) @ z
                second += (z * curve[y, mark // CELL][:, None]).T @ z
                np.add.at(sums, (y, mark // CELL), z)
            flat = np.concatenate([gradient, second.ravel(), sums.ravel()])
            at = np.flatnonzero(flat)
            for lo in range(0, len(at), 1 << 16):
                part = at[lo : lo + (1 << 16)]
                yield pa.record_batch({"at": pa.array(part), "v": pa.array(flat[part])})

        found = self.known.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
        flat = np.zeros(size + size * size + 2 * many * size)
        flat[found.column("at").to_numpy()] = found.column("v").to_numpy()
        gradient, second, sums = flat[:size], flat[size : size + size * size].reshape(size, size), flat[size + size * size :].reshape(2, many, size)
        both = sums[1].T @ _across(sums[0], bend, wide)
        return gradient, second - both - both.T


def _least_loss(pairs: _Pairs) -> np.ndarray:
    """Newton's method: the weights of least mean loss and ridge; the loss falls with each step."""
    n = float(pairs.good) * pairs.bad
    w = np.zeros(len(pairs.scale))
    axis = pairs.axis(w * pairs.scale)
    loss = axis.loss() / n
    for _ in range(60):
        gradient, curvature = pairs.derivatives(axis)
        gradient = gradient / n + RIDGE * w
        values, vectors = np.linalg.eigh(curvature / n + RIDGE * np.eye(len(w)))
        step = -vectors @ ((vectors.T @ gradient) / np.maximum(values, RIDGE))
        if -gradient @ step < 1e-9:
            break
        size, found = 1.0, False
        while size > 1e-3 and not found:
            new = w + size * step
            there = pairs.axis(new * pairs.scale)
            at = there.loss() / n + RIDGE / 2 * float(new @ new)
            if found := at < loss:
                w, axis, loss = new, there, at
            size /= 2
        if not found:
            break
    return w * pairs.scale


def _quantile(values: DataFrame, n: int, share: float) -> float:
    """The exact quantile of the ``n`` values s, between two of them in proportion: they are counted in ever narrower bins."""
    place = share * (n - 1)
    k = left = int(place)
    low, high = values.agg(F.min("s"), F.max("s")).first()
    while low < high:
        of_bin = F.least(F.lit(4095), F.floor((F.col("s") - low) / (high - low) * 4096))
        inside = values.where(F.col("s").between(low, high))
        for r in inside.groupBy(of_bin.alias("bin")).agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).orderBy("bin").collect():
            if left < r.n:
                break
            left -= r.n
        low, high = r.low, r.high
    upto, after = values.agg(F.count_if(F.col("s") <= low), F.min(F.when(F.col("s") > low, F.col("s")))).first()
    above = low if upto > k + 1 or after is None else after
    return low + (place - k) * (above - low)


def _fit(described: DataFrame, labels: DataFrame) -> QualityModel:
    known = described.select("doc_id", "f").join(known_labels(labels, "quality", FOLDS, HELD_OUT), "doc_id").select("y", "f")
    known = materialize(known, "quality")
    pairs = _Pairs(known)
    if not (pairs.good and pairs.bad):
        return QualityModel((0.0,) * len(features("")), 0.0)
    weights = tuple(_least_loss(pairs).tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch({"s": pa.array(_weighted(_rows_of(b), weights))})

    n = pairs.good + pairs.bad
    return QualityModel(weights, _quantile(materialize(known.mapInArrow(run, "s double"), "scores"), n, pairs.bad / n))


def fit_quality(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Learn from labels(doc_id, quality) of docs(doc_id, text) outside the held-out fold.

    All labelled rows and all pairs of them take part. Without rows of both kinds every score is CUT.
    """
    return _fit(_described(docs), labels)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Null and empty texts are scored like any other. A null doc_id is in the fold of the
    empty text. Repeated rows get equal scores; an empty table gives no rows.
    """
    described = _described(docs)
    model = _fit(described, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch({"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "score": pa.array(model.scores(_rows_of(b)))})

    scored = described.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents scored at or above the threshold; all columns stay."""
    model = fit_quality(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, "text"):
            yield b.filter(pa.array(model.scores(_widened(_bases_of(b))) >= CUT))

    return docs.mapInArrow(run, docs.schema)
