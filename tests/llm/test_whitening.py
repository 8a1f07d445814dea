"""Whitening against a dense eigendecomposition, and the contour integration on hard spectra."""

import math

import numpy as np
import pytest

from screenloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, v string, x int, w string, component int, n string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "v", 1, "w", 2, "n") for r in rows], SCHEMA)


def spectra():
    rng = np.random.default_rng(3)
    for d in (1, 2, 9, 64, 130):
        for kind in range(6):
            a = rng.standard_normal((3 * d, d))
            if kind == 1:
                a *= np.logspace(0, -4, d)
            if kind == 2:
                a = a[: max(1, d // 3)]
            if kind == 3:
                a = np.ones((4, d)) * np.arange(4)[:, None]
            if kind == 4:
                a[:, -1] = a[:, 0]
            a -= a.mean(0)
            yield d, kind, np.eye(d) * 3 if kind == 5 else a.T @ a / len(a)


@pytest.mark.parametrize(("d", "kind", "matrix"), [pytest.param(d, k, m, id=f"{d}-{k}") for d, k, m in spectra()])
def test_contours_find_what_a_dense_solver_finds(d, kind, matrix):
    want = np.linalg.eigvalsh(matrix)[::-1]
    values, vectors = whitening.leading(matrix, 8)
    want = want[:8][want[:8] > 1e-10 * want[0]] if want[0] > 0 else want[:0]
    assert len(values) == len(want)
    assert np.allclose(values, want, rtol=1e-12, atol=1e-13 * max(want, default=0))
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
    assert np.allclose(matrix @ vectors, vectors * values, atol=1e-12 * max(want, default=0))


def test_inertia_counts():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 30):
        m = rng.standard_normal((n, n))
        m = m + m.T
        for shift in (-3.0, -0.1, 0.0, 0.4, 2.5):
            assert whitening.below(m, shift) == (np.linalg.eigvalsh(m) < shift).sum()
    assert whitening.below(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


def test_against_a_dense_solver(spark):
    rng = np.random.default_rng(5)
    x = (rng.standard_normal((400, 12)) * np.linspace(1, 0.2, 12)).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(None, rows[0][1]), (7, rows[7][1]), (500, [0.5, -0.25]), (501, [])]
    bad = [(600, None), (601, [1.0, None]), (602, [math.nan] * 12), (603, [math.inf, 1.0]), (604, [1e30] * 12)]
    found = whitening.whiten(table(spark, rows + bad)).collect()
    whole = np.array([[math.floor(1024 * c) + 100000 for c in v] + [100000] * (12 - len(v)) for _, v in rows])
    n, s = len(whole), whole.sum(0)
    values, vectors = np.linalg.eigh(np.cov(whole.T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    white = (whole - s / n) @ vectors / np.sqrt(values)
    deviation = ((n * whole - s) ** 2).sum(1)
    want = sorted(((v, c + 1, int(deviation[r]), white[r, c]) for r, (v, _) in enumerate(rows) for c in range(8)), key=lambda t: (t[1], t[2], str(t[0]), abs(t[3])))
    got = sorted(((r.vec_id, r.component, r.deviation, r.whitened) for r in found), key=lambda t: (t[1], t[2], str(t[0]), abs(t[3])))
    assert [t[:3] for t in got] == [t[:3] for t in want]
    for c in range(1, 9):
        a, b = (np.array([t[3] for t in side if t[1] == c]) for side in (got, want))
        assert np.allclose(a, b * np.sign(a @ b), atol=1e-9)
    assert all(r.n == n and r.identity_error < 1e-9 and abs(r.explained - values[r.component - 1] / values.sum()) < 1e-12 for r in found)


def test_little_variance(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, None), (2, [])])).count() == 0
    same = whitening.whiten(table(spark, [(i, [1.0, 2.0, 3.0]) for i in range(5)])).collect()
    assert len(same) == 15 and all(r.whitened is None and r.deviation == 0 and r.explained == 0 and r.identity_error == 0 for r in same)
    line = whitening.whiten(table(spark, [(i, [float(i), 2.0 * i]) for i in range(5)])).collect()
    assert len(line) == 10 and all((r.whitened is None) == (r.component == 2) for r in line)
    with pytest.raises(ValueError, match="dimensions"):
        whitening.whiten(table(spark, [(1, [0.0] * (whitening.MOST_DIMENSIONS + 1))]))
