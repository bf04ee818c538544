import math
import random
from collections import defaultdict

import numpy as np
import pytest

from tagloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n string"


def plain(rows):
    """Components by a dense eigenvalue decomposition of the whole covariance."""
    width = max((len(v) for _, v in rows if v is not None), default=0)
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in good), default=0)
    xs = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v) + (0,) * (width - len(v))) for i, v in good]
    fit = sorted({x for _, x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    cov = y.T @ y / n
    e, q = np.linalg.eigh(cov)
    return xs, n, sums, e[::-1], q[:, ::-1], np.trace(cov)


def check(spark, rows, parts=3):
    got = whitening.whiten(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(parts)).collect()
    xs, n, sums, e, q, trace = plain(rows)
    k = min(4, int((e > 1e-10 * max(e[0], 1e-300)).sum()))
    assert len(got) == k * len(xs)
    by = defaultdict(set)
    for i, x in xs:
        y = np.array([(n * c - s) / n for c, s in zip(x, sums)])
        by[i].add((sum((n * c - s) ** 2 for c, s in zip(x, sums)), tuple((y @ q[:, :k] / np.sqrt(e[:k])).tolist())))
    signs = {}
    for r in got:
        j = r["component"] - 1
        assert r["n"] == n and r["identity_error"] < 1e-9 and r["explained"] == pytest.approx(e[j] / trace, rel=1e-9)
        want = [w[j] for d, w in by[r["vec_id"]] if d == r["deviation"]]
        assert want and min(abs(abs(w) - abs(r["whitened"])) for w in want) < 1e-7
        if len(want) == 1 and abs(want[0]) > 1e-3:
            assert signs.setdefault(j, want[0] * r["whitened"] > 0) == (want[0] * r["whitened"] > 0)
    return got


def test_against_eigenvalues_of_the_covariance(spark):
    rng = np.random.default_rng(1)
    flat = [(i, [float(c) for c in v]) for i, v in enumerate(rng.standard_normal((150, 12)))]
    steep = [(i, [float(c) for c in v]) for i, v in enumerate(rng.standard_normal((150, 12)) * 0.5 ** np.arange(12) + 3)]
    check(spark, flat)
    check(spark, steep + steep[:40] + [(500, None), (501, [1.0, None] * 6), (502, [float("nan")] * 12), (503, [float("-inf")] * 12), (3, flat[0][1])])


def test_low_rank_short_vectors_and_few_rows(spark):
    rnd = random.Random(2)
    check(spark, [(i, [float(a), float(2 * a), float(-a), 0.5]) for i, a in enumerate(rnd.sample(range(100), 30))])
    check(spark, [(i, [rnd.random() for _ in range(rnd.randint(3, 6))]) for i in range(60)])
    check(spark, [(1, [1.0, 2.0]), (2, [2.0, 1.0])])


def test_equal_vectors_empty_vectors_and_empty_table(spark):
    for rows in ([], [(1, None)], [(1, [])], [(1, [0.5, 0.25])] * 3):
        assert whitening.whiten(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect() == []


def test_deviations_beyond_a_long_are_null_and_huge_entries_pass(spark):
    rows = [(1, [1e17, 0.0], ""), (2, [0.0, 1.0], ""), (3, [3e38, -3e38], "")]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["vec_id"] for r in got} == {1, 2, 3} and all(r["deviation"] is None for r in got)


def test_repeated_eigenvalues_are_all_found():
    y = np.diag([5.0, 5.0, 5.0, 2.0, 1.0, 1.0])
    axes, s = whitening.bidiagonal_components(lambda w: (y.T @ (y @ w), float((y @ w) @ (y @ w))), 6, float((y**2).sum()), 4)
    assert np.allclose(s, [5, 5, 5, 2]) and np.allclose(np.abs(axes[3, 3]), 1) and np.allclose(axes.T @ axes, np.eye(4), atol=1e-13)


def test_stops_before_all_directions_on_steep_spectra():
    rng, steps = np.random.default_rng(3), []
    y = rng.standard_normal((300, 40)) * 0.3 ** np.arange(40)
    product = lambda w: (steps.append(1), (y.T @ (y @ w), float((y @ w) @ (y @ w))))[1]
    axes, s = whitening.bidiagonal_components(product, 40, float((y**2).sum()), 4)
    _, want, vt = np.linalg.svd(y)
    assert len(steps) < 30 and np.allclose(s, want[:4], rtol=1e-12) and np.allclose(np.abs(np.sum(axes * vt[:4].T, axis=0)), 1, atol=1e-12)
