import hashlib
import random

import numpy as np
import pytest

from corpusloom.llm import codes, limbs

SCHEMA = "vec_id long, embedding array<double>, label string, code string, part int, vector int"


def brute(rows, parts=4, entries=256, rounds=4):
    """Python integers and loops."""
    kept = [(i, [math_floor(1024 * x) for x in v], lab) for i, v, lab, *_ in rows if v is not None and all(x is not None and abs(x) < float("inf") for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    kept = [(i, v + [0] * (width - len(v)), lab) for i, v, lab in kept]
    size = width // parts
    cut = lambda v: [v[p * size : (p + 1) * size] for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        groups = [{} for _ in range(parts)]
        for _, v, _ in kept:
            for p, x in enumerate(cut(v)):
                groups[p].setdefault(nearest(x, books[p])[1], []).append(x)
        books = [[[sum(c) // len(groups[p][k]) for c in zip(*groups[p][k], strict=True)] if k in groups[p] else e for k, e in enumerate(b)] for p, b in enumerate(books)]
    out, sums = [], {}
    for i, v, lab in kept:
        found = [nearest(x, books[p]) for p, x in enumerate(cut(v))]
        error = sum(d for d, _ in found)
        sums[lab] = sums.get(lab, 0) + error
        out.append((i, lab, "".join(f"{k:02x}" for _, k in found), error))
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(repr((*r, sums[r[1]], sha)) for r in out)


def math_floor(x):
    import math

    return math.floor(x)


def got_of(df):
    return sorted(repr(tuple(r)) for r in df.select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256").collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA).repartition(3)


def vectors(n, dim, seed, values=None):
    pick = random.Random(seed)
    draw = (lambda: pick.choice(values)) if values else (lambda: pick.gauss(0, 0.3))
    return [(i, [draw() for _ in range(dim)], pick.choice(["a", "b", None])) for i in range(n)]


AWKWARD = [
    (None, [0.5] * 8, "a"), (None, [0.25] * 8, None), (3, None, "a"), (4, [0.1, None] * 4, "a"), (5, [float("nan")] + [0.0] * 7, "b"),
    (6, [float("-inf")] + [0.0] * 7, "b"), (7, [0.1] * 8, "zz"), (7, [0.1] * 8, "zz"), (7, [0.2] * 8, "zz"),
]


@pytest.mark.parametrize("entries", [256, 5])
def test_against_brute_force(spark, entries):
    rows = vectors(60, 8, 1) + AWKWARD
    assert got_of(codes.compress_vectors(table(spark, rows), entries=entries)) == brute(rows, entries=entries)


def test_ties_and_unused_entries(spark):
    rows = vectors(80, 4, 2, [0.0, 0.5, -0.5]) + [(100 + i, [0.0] * 4, "hot") for i in range(60)]
    assert got_of(codes.compress_vectors(table(spark, rows), entries=20)) == brute(rows, entries=20)


def test_uneven_lengths_are_continued_with_zeros(spark):
    rows = [(1, [0.1, 0.2, 0.3], "a"), (2, [0.5] * 7, "b"), (3, [], None), (4, [-0.7], "a")]
    assert got_of(codes.compress_vectors(table(spark, rows), entries=2)) == brute(rows, entries=2)


def test_many_labels_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(codes, "BROADCAST_LABELS", 0)
    rows = vectors(50, 8, 3) + AWKWARD
    assert got_of(codes.compress_vectors(table(spark, rows), entries=9)) == brute(rows, entries=9)


def test_empty_tables(spark):
    assert codes.compress_vectors(table(spark, [])).count() == 0
    assert codes.compress_vectors(table(spark, [(1, None, "a"), (2, [None], "a")])).count() == 0
    assert codes.compress_vectors(table(spark, [(1, [], "a")])).count() == 1


def test_large_components(spark):
    """Distances over 2^53 need several limbs; components beyond what a distance can hold are set to the largest."""
    rows = [(i, [x * 2.0**14 for x in v], lab) for i, v, lab in vectors(40, 8, 5)]
    assert got_of(codes.compress_vectors(table(spark, rows), entries=7)) == brute(rows, entries=7)
    far = codes.compress_vectors(table(spark, [(1, [1e30, -1e300] * 4, "a"), (2, [0.0] * 8, "a")]), entries=1, rounds=0).collect()
    assert sorted(r["error"] for r in far)[0] == 0 and sorted(r["error"] for r in far)[1] > 1 << 60


@pytest.mark.parametrize("top,inner", [(10, 16), (1 << 20, 16), (1 << 28, 16), (1 << 28, 500), ((1 << 31) - 1, 1)])
def test_exact_products(top, inner):
    draw = np.random.default_rng(top + inner)
    a, b = draw.integers(-top, top, (30, inner)), draw.integers(-top, top, (20, inner))
    a[0], b[0] = -top, top
    exact = a.astype(object) @ b.T.astype(object)
    fits = np.abs(exact.astype(float)) < 2.0**62
    for width in (None, 3, 11):
        assert (limbs.dot(a, b, width).astype(object) == exact)[fits].all()
    for part in limbs.limbs(a, 7):
        assert np.abs(part).max() <= 1 << 7
    assert (sum(p.astype(object) * (1 << (7 * i)) for i, p in enumerate(limbs.limbs(a, 7))) == a).all()
