import math
import random

import numpy as np

from corpusloom.llm import topk


def brute(rows, every=50, k=5):
    finite = [
        (i, [math.floor(256 * x) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, a in finite:
        if q % every == 0:
            scored = [(-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in finite if i != q and len(a) == len(b)]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def vectors(seed, n, dim=16, spread=1.0):
    pick = random.Random(seed)
    rows = [(i, [pick.gauss(0, spread) for _ in range(dim)]) for i in range(n)]
    for i in pick.sample(range(n), n // 3):
        rows[i] = (i, rows[7][1])  # a third of all rows is one vector
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS vector", "2 AS cut").repartition(5)


def found(df, **options):
    return sorted(map(tuple, topk.neighbours(df, **options).collect()))


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    monkeypatch.setattr(topk, "QUERIES", 8)
    rows = vectors(1, 700)
    assert found(table(spark, rows), every=20) == brute(rows, 20)


def test_awkward_vectors(spark):
    rows = vectors(2, 60, 5) + [
        (100, None), (150, [1.0, None, 0.0, 0.0, 0.0]), (200, [float("nan")] * 5), (250, [float("inf")] * 5),
        (300, [0.0] * 5), (350, [-0.001] * 5), (400, [1.0, 2.0]), (450, [3.0, 1.0]), (500, []), (None, [1.0] * 5), (551, []),
    ]
    assert found(table(spark, rows)) == brute(rows)


def test_large_components_stay_exact():
    pick = np.random.default_rng(1)
    a, b = (pick.integers(-(1 << 28), 1 << 28, (3, 9)) for _ in range(2))
    assert (sum(topk.partial_scores(a, b, 4)) == a @ b.T).all()
    a, b = (pick.integers(-100, 100, (3, 2)) for _ in range(2))
    assert (sum(topk.partial_scores(a, b, 4)) == a @ b.T).all()


def test_repeated_queries(spark):
    """Equal rows ask once; other vectors under the same id ask for themselves; candidates count each."""
    rows = vectors(4, 40, 4) + [(0, [0.5, 0.1, -0.2, 0.9]), (7, [0.1, 0.2, 0.3, 0.4])]
    twice = [*rows, rows[0], rows[0], (9, rows[9][1])]
    once = brute([r for n, r in enumerate(twice) if r[0] != 0 or n in (0, 40)])
    assert found(table(spark, twice)) == once and len(once) == 10


def test_empty_and_single(spark):
    assert found(table(spark, [])[["vec_id", "embedding"]]) == []
    assert found(table(spark, [(0, [1.0, 2.0])])) == []
