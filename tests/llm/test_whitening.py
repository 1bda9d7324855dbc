"""Operator 13 against dense eigenvectors, exact integers and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.llm import whitening

VECTORS = "vec_id long, embedding array<double>"


def dense(v, components=32):
    x = np.array([[int(c) for c in np.floor(64 * r)] for r in v], dtype=object) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    y = (n * x - total) / n
    y = y.astype(float)
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return n, ((n * x - total) ** 2).sum(axis=1), y @ u / np.sqrt(e), e, (y * y).sum() / n


def frame(spark, v, first=0):
    return spark.createDataFrame([(first + i, r.tolist()) for i, r in enumerate(v)], VECTORS)


def compare(got, v, components=32, tolerance=1e-8):
    n, deviation, whitened, e, trace = dense(v, components)
    w = np.zeros_like(whitened)
    for r in got:
        w[r.vec_id, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == deviation[r.vec_id] and r.identity_error <= 1e-9
        assert abs(r.explained / (e[r.component - 1] / trace) - 1) < 1e-9
    assert len(got) == w.size
    assert np.abs(w * np.sign((w * whitened).sum(axis=0)) - whitened).max() < tolerance


@pytest.mark.parametrize("n,d", [(500, 64), (300, 5), (40, 33), (200, 90)])
def test_whitening(spark, n, d):
    r = np.random.default_rng(d)
    v = r.normal(size=(n, d)) * np.geomspace(3, 0.3, d) + r.normal(size=d) * 20
    more = frame(spark, v).withColumns({"n": F.lit("x"), "component": F.lit(1), "x": F.lit(None).cast("int"), "dim": F.lit(0), "slice": F.lit("s")})
    compare(whitening.whiten(more).collect(), v)


def test_unusable_vectors_and_repeats(spark):
    r = np.random.default_rng(3)
    v = r.normal(size=(60, 4))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    bad = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0]), (103, [1.0, float("nan"), 1.0, 1.0]), (104, [float("inf")] * 4), (105, [1e300, 0.0, 0.0, 0.0])]
    compare(whitening.whiten(spark.createDataFrame(rows + bad, VECTORS)).collect(), v)
    again = whitening.whiten(spark.createDataFrame(rows + rows[:1] + [(None, rows[0][1])], VECTORS)).collect()
    assert sorted(sum(r.vec_id == k for r in again) for k in (0, 1)) == [4, 8] and sum(r.vec_id is None for r in again) == 4
    assert {r.n for r in again} == {62}


def test_tables_without_variance(spark):
    for v in ([], [[1.0, 2.0]], [[0.5, 0.25]] * 9):
        assert whitening.whiten(spark.createDataFrame([(i, x) for i, x in enumerate(v)], VECTORS)).count() == 0


def test_rank_and_dimensions(spark):
    """Directions without variance have no rows; each dimension is fitted on its own."""
    r = np.random.default_rng(5)
    flat = np.repeat(r.normal(size=(80, 2)).round(3), 2, axis=1)
    got = whitening.whiten(frame(spark, flat).union(frame(spark, r.normal(size=(50, 3)), 1000))).collect()
    assert {(r.vec_id >= 1000, r.n, r.component) for r in got} == {(False, 80, 1), (False, 80, 2), (True, 50, 1), (True, 50, 2), (True, 50, 3)}


def test_deviations_are_exact_or_null(spark):
    v = np.array([[1e9, 0.0], [-1e9, 3.0], [5e12, 1.0], [0.0, 7e13]])
    n, want, *_ = dense(v)
    got = {r.vec_id: r.deviation for r in whitening.whiten(frame(spark, v)).collect()}
    assert got == {i: int(w) if w < 2**63 else None for i, w in enumerate(want)}
    centre = whitening.Centre(3, [7, -8])
    x = np.array([[10, -2], [2**40, 5]], dtype=np.int64)
    assert centre.deviations(x) == [(30 - 7) ** 2 + (-6 + 8) ** 2, None] and np.allclose(centre.rows(x), x - np.array([7, -8]) / 3)
    assert centre.deviations(np.array([[2**29, 0]], dtype=np.int64)) == [(3 * 2**29 - 7) ** 2 + 64]


@pytest.mark.parametrize("d,wanted", [(3, 32), (70, 32), (400, 32), (600, 5)])
def test_lobpcg_certifies_residuals(d, wanted):
    r = np.random.default_rng(d)
    y = r.normal(size=(2000, d)) * np.geomspace(10, 0.1, d)
    a = y.T @ y / len(y)
    calls = []

    def product(block):
        calls.append(block.shape[1])
        return a @ block

    e, x, residual = whitening.lobpcg(product, d, wanted)
    k = min(d, wanted)
    want, u = np.linalg.eigh(a)
    assert e.shape == (k,) and residual <= whitening.ENOUGH
    assert np.abs(e - want[::-1][:k]).max() < 1e-13 * e[0] and np.abs(e / want[::-1][:k] - 1).max() < 1e-10
    assert np.abs(np.abs((u[:, ::-1][:, :k] * x).sum(axis=0)) - 1).max() < 1e-10
    assert len(calls) < 60 and max(calls) <= k + whitening.GUARD
