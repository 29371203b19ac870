import math
import random

import numpy as np
import pytest

from corpusloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component int, n string, value double"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "clash", 0.5) for i, v in rows], SCHEMA).repartition(3)


def vectors(n, dim, seed):
    pick = random.Random(seed)
    scale = [0.2 + 3 / (1 + j) for j in range(dim)]
    return [(i, [float(np.float32(pick.gauss(0.1 * j, s))) for j, s in enumerate(scale)]) for i in range(n)]


def brute(rows):
    """Python integers, then LAPACK on the exact covariance."""
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(len(v) for _, v in kept)
    x = [[math.floor(64 * c) + 1_000_000 for c in v] + [1_000_000] * (width - len(v)) for _, v in kept]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    off = np.array([[n * c - t for c, t in zip(r, s, strict=True)] for r in x], object)
    matrix = np.array((off.T @ off) / n**3, float)
    values, axes = np.linalg.eigh(matrix)
    return [i for i, _ in kept], off, values[::-1], axes[:, ::-1], matrix


def check(got, rows, wanted=32):
    ids, off, values, axes, matrix = brute(rows)
    n = len(ids)
    rank = int((values > len(values) * 2.3e-16 * np.abs(matrix).sum(axis=1).max()).sum())
    m = min(wanted, rank)
    assert len(got) == n * m and {r["n"] for r in got} == {n}
    by_row = {}
    for r in got:
        by_row.setdefault((r["vec_id"], r["deviation"]), []).append(r)
    expected = {}
    for i, o in zip(ids, off, strict=True):
        expected.setdefault((i, int((o * o).sum())), []).append((o.astype(float) / n) @ axes[:, :m] / np.sqrt(values[:m]))
    assert {k: len(v) for k, v in by_row.items()} == {k: m * len(v) for k, v in expected.items()}
    for k, copies in expected.items():
        for c in range(m):
            mine = sorted(abs(r["whitened"]) for r in by_row[k] if r["component"] == c + 1)
            assert np.allclose(mine, sorted(abs(w[c]) for w in copies), rtol=1e-6, atol=1e-7)
    for r in got:
        share = values[r["component"] - 1] / np.trace(matrix)
        assert abs(r["explained"] - share) <= 1e-9 * share and 0 <= r["identity_error"] <= 1e-8


@pytest.mark.parametrize("n,dim", [(300, 6), (200, 40), (20, 40)])
def test_against_lapack(spark, n, dim):
    rows = vectors(n, dim, n + dim)
    check(whitening.whiten(table(spark, rows)).collect(), rows)


def test_awkward_rows(spark):
    rows = vectors(50, 5, 1) + [
        (None, [0.1, 0.5, 0.2, 0.9, 0.0]), (None, [0.4] * 5), (1, [0.4] * 5), (1, [0.4] * 5), (2, None), (3, [None] * 5),
        (4, [float("nan")] * 5), (5, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (6, [1.0, 2.0]), (7, []),
    ]
    check(whitening.whiten(table(spark, rows)).collect(), rows)


def test_signs_are_the_same_for_all_rows(spark):
    rows = vectors(100, 4, 9)
    got = whitening.whiten(table(spark, rows)).collect()
    white = np.zeros((100, 4))
    for r in got:
        white[r["vec_id"], r["component"] - 1] = r["whitened"]
    assert np.allclose(white.T @ white / 100, np.eye(4), atol=1e-10)


def test_no_spread_no_rows(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, [0.5, 0.5])])).count() == 0
    assert whitening.whiten(table(spark, [(i, [0.5, 0.25]) for i in range(9)])).count() == 0
    assert whitening.whiten(table(spark, [(1, []), (2, [])])).count() == 0


def test_large_components(spark):
    rows = [(i, [x * 4096 for x in v]) for i, v in vectors(60, 6, 3)]
    check(whitening.whiten(table(spark, rows)).collect(), rows)
    huge = whitening.whiten(table(spark, [(i, [1e30 * (-1) ** i, 0.5 * i]) for i in range(8)])).collect()
    assert len(huge) == 16


@pytest.mark.parametrize("d", [1, 2, 9, 64, 120])
def test_components_against_lapack(d):
    draw = np.random.default_rng(d)
    basis = np.linalg.qr(draw.standard_normal((d, d)))[0]
    spectra = [draw.random(d) + 0.1, 3.0 ** -np.arange(d, dtype=float), np.ones(d), np.repeat([5.0, 1.0], [d - d // 3, d // 3])]
    for spectrum in spectra:
        matrix = basis @ np.diag(spectrum) @ basis.T
        matrix = (matrix + matrix.T) / 2
        cut = whitening.intervals(matrix, 32)
        found = [whitening.project(matrix, *x) for x in cut]
        values = np.sort(np.concatenate([v for v, _ in found]))[::-1]
        assert len(values) >= min(32, (spectrum > 1e-9).sum())
        assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][: len(values)], atol=1e-13 * d, rtol=0)
        for v, x in found:
            assert np.abs(matrix @ x - x * v).max() < 1e-12


def test_inertia_counts_every_eigenvalue():
    draw = np.random.default_rng(3)
    for _ in range(400):
        d = int(draw.integers(1, 14))
        a = draw.integers(-3, 4, (d, d)).astype(float)
        a, s = a + a.T, float(draw.standard_normal())
        assert whitening.above(a, s) == (np.linalg.eigvalsh(a) > s).sum()


def test_a_missing_component_is_noticed(monkeypatch):
    """If a contour doesn't give as many as were counted, the operator fails rather than leave one out."""
    matrix = np.diag([3.0, 2.0, 1.0])
    with pytest.raises(ArithmeticError):
        whitening.project(matrix, 0.5, 4.0, 2)
