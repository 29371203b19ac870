"""Operator 13, whitening by contour integration.

The covariance is added up in exact integers. Inertia counts (signs of a symmetric factorisation of the
shifted matrix) cut its spectrum into intervals that hold few eigenvalues each. For every interval, a
quadrature of complex shifted solves around it projects a block of vectors onto its eigenvectors, a
Rayleigh-Ritz step extracts them, and the count says whether any is missing. Intervals are solved by
tasks of their own; rows are projected where they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shipping import ship
from .limbs import dense, dot, floored, longest
from .shared import keep

ship(__name__)

#: Components are floor(64 * x), at most this far from 0; a constant is added to each.
LIMIT, SHIFT = 1 << 28, 1_000_000
#: Rows worked on at once, nodes on half a contour, eigenvalues of an interval, and rounds.
AT_ONCE, NODES, IN_INTERVAL, ROUNDS = 4096, 12, 8, 40


def exact_gram(rows: np.ndarray) -> np.ndarray:
    """``rows.T @ rows`` as Python integers."""
    n, d = rows.shape
    top = max(int(np.abs(rows).max(initial=0)), 1)
    step = max((1 << 62) // (top * top), 1)
    total = np.zeros((d, d), object)
    for at in range(0, n, step):
        part = np.ascontiguousarray(rows[at : at + step].T)
        total = total + dot(part, part).astype(object)
    return total


def blocks(batch: pa.RecordBatch, width: int):
    for at in range(0, batch.num_rows, AT_ONCE):
        rows = batch.slice(at, AT_ONCE)
        yield rows, dense(rows.column("vector"), width)


def moments(vectors: DataFrame, width: int) -> tuple[int, list[int], np.ndarray]:
    """Rows, sums and sums of products of the components, exact. Tasks add up; a row per pair of components is collected."""

    def run(batches_):
        n, total, products = 0, np.zeros(width, object), np.zeros((width, width), object)
        for batch in batches_:
            for _, matrix in blocks(batch, width):
                n += len(matrix)
                total = total + matrix.sum(axis=0).astype(object)
                products = products + exact_gram(matrix)
        if n:
            i, j = np.triu_indices(width)
            values = [str(n), *map(str, total), *map(str, products[i, j])]
            first = np.concatenate([[-1], np.arange(width), i]).astype(np.int32)
            second = np.concatenate([[-1], np.full(width, -1), j]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(second), pa.array(values)], ["i", "j", "value"])

    found = vectors.mapInArrow(run, "i int, j int, value string").groupBy("i", "j")
    n, total, products = 0, [0] * width, np.zeros((width, width), object)
    for r in found.agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
        value = int(r["value"])
        if r["i"] < 0:
            n = value
        elif r["j"] < 0:
            total[r["i"]] = value
        else:
            products[r["i"], r["j"]] = products[r["j"], r["i"]] = value
    return n, total, products


def covariance(n: int, total: list[int], products: np.ndarray) -> np.ndarray:
    """Mean product of centred components: the integers are exact, each entry is rounded once."""
    sums = np.array(total, object)
    scatter = n * products - sums[:, None] * sums[None, :]
    return np.array([[int(x) / (n * n) for x in row] for row in scatter], np.float64).reshape(len(total), len(total))


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues are larger: positive pivots of ``matrix - shift`` (Bunch-Kaufman)."""
    a = matrix - shift * np.eye(len(matrix))
    n, k, positive, alpha = len(a), 0, 0, (1 + 17**0.5) / 8

    def swap(x: int, y: int) -> None:
        a[[x, y]] = a[[y, x]]
        a[:, [x, y]] = a[:, [y, x]]

    while k < n:
        column = np.abs(a[k + 1 :, k])
        most = column.max(initial=0.0)
        two = False
        if most > 0 and abs(a[k, k]) < alpha * most:
            r = k + 1 + int(column.argmax())
            across = np.abs(a[r, k:])
            across[r - k] = 0
            far = across.max()
            if abs(a[k, k]) * far >= alpha * most * most:
                pass
            elif abs(a[r, r]) >= alpha * far:
                swap(k, r)
            else:
                swap(k + 1, r)
                two = True
        if two:
            block, left = a[k : k + 2, k : k + 2].copy(), a[k + 2 :, k : k + 2].copy()
            a[k + 2 :, k + 2 :] -= left @ np.linalg.solve(block, left.T)
            positive, k = positive + 1, k + 2  # such a pivot has one eigenvalue of each sign
        else:
            pivot = a[k, k]
            if pivot != 0:
                left = a[k + 1 :, k].copy()
                a[k + 1 :, k + 1 :] -= np.outer(left, left / pivot)
            positive, k = positive + int(pivot > 0), k + 1
    return positive


def intervals(matrix: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """``low, high, eigenvalues in it`` of disjoint intervals that hold the ``wanted`` largest ones, zeros aside."""
    norm = float(np.abs(matrix).sum(axis=1).max(initial=0.0))
    if not norm:
        return []
    least = len(matrix) * 2.0**-52 * norm  # below, an eigenvalue is zero to rounding
    wanted = min(wanted, above(matrix, least))
    out, todo = [], [(least, norm * (1 + 1e-6), above(matrix, least), 0)]
    while todo and sum(c for *_, c in out) < wanted:
        low, high, over_low, over_high = todo.pop()
        if over_low == over_high:
            continue
        if over_low - over_high <= IN_INTERVAL or high - low < 1e-9 * norm:
            out.append((low, high, over_low - over_high))
            continue
        middle = (low + high) / 2 if 8 * low > high else (low * high) ** 0.5
        over = above(matrix, middle)
        todo += [(low, middle, over_low, over), (middle, high, over, over_high)]
    return out


def project(matrix: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues between low and high and their vectors, by a filtered subspace iteration."""
    d = len(matrix)
    norm, eye = np.abs(matrix).sum(axis=1).max(), np.eye(d)
    node, weight = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * np.pi / 2 * (1 - node))
    centre, radius = (low + high) / 2, (high - low) / 2
    size = min(d, 2 * count + 8)
    while True:
        block = np.random.default_rng(size).standard_normal((d, size))
        last = np.inf
        for _ in range(ROUNDS):
            filtered = sum(
                w / 2 * np.real(radius * t * np.linalg.solve((centre + radius * t) * eye - matrix, block + 0j))
                for t, w in zip(turn, weight, strict=True)
            )
            basis = np.linalg.qr(filtered)[0]
            values, mixed = np.linalg.eigh(basis.T @ matrix @ basis)
            block = basis @ mixed
            inside = np.flatnonzero((values > low) & (values <= high))
            worst = np.abs(matrix @ block[:, inside] - block[:, inside] * values[inside]).max(initial=0.0)
            if len(inside) == count and (worst <= 1e-15 * norm or (worst <= 1e-12 * norm and worst >= last)):
                return values[inside], block[:, inside]
            last = worst
        if size == d:
            raise ArithmeticError(f"{count} eigenvalues between {low} and {high} were not found")
        size = min(d, 2 * size)


def components(df: DataFrame, matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit vectors; each interval is a task's work."""
    spark, d = df.sparkSession, len(matrix)
    cut = intervals(matrix, wanted)
    if not cut:
        return np.zeros(0), np.zeros((d, 0))
    sent = spark.sparkContext.broadcast(matrix)

    def run(batches_):
        for batch in batches_:
            for row in batch.to_pylist():
                values, vectors = project(sent.value, row["low"], row["high"], row["count"])
                yield pa.RecordBatch.from_pydict({"value": values, "vector": list(vectors.T)})

    rows = spark.createDataFrame(cut, "low double, high double, count int").repartition(len(cut))
    found = rows.mapInArrow(run, "value double, vector array<double>").collect()
    # Vectors of different intervals are made exactly orthogonal by one more Rayleigh-Ritz step.
    basis = np.linalg.qr(np.array([r["vector"] for r in sorted(found, key=lambda r: -r["value"])]).T)[0]
    values, mixed = np.linalg.eigh(basis.T @ matrix @ basis)
    values, vectors = values[::-1][:wanted], (basis @ mixed)[:, ::-1][:, :wanted]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values, vectors * signs


def centred(matrix: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """``n * x - S``, exact: int64 if its squares' sum fits, else Python integers."""
    top = n * int(np.abs(matrix).max(initial=0)) + max(map(abs, total), default=0)
    if top * top * max(matrix.shape[1], 1) < 1 << 63:
        return n * matrix - np.array(total, np.int64)
    return n * matrix.astype(object) - np.array(total, object)


def whiten(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    wanted: int = 32,
    scale: int = 64,
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row per vector and component.

    Components x become floor(scale * x) + ``SHIFT``. ``whitened`` is the centred vector along a unit
    eigenvector of the covariance, over the root of its eigenvalue e; ``explained`` is e over the trace,
    ``deviation`` the exact sum of (n x - S)^2, and ``identity_error`` how far the covariance of all
    whitened rows is from the identity, at most.

    Vectors that are null or hold a null or non-finite component are left out; a null id is carried
    along; repeated rows count each; vectors shorter than the longest one count as continued with zeros.
    Components whose eigenvalue is zero to rounding have no whitened value and no rows (so a table of
    equal vectors, or an empty one, gives none). Integers beyond 2^28 are set to it; a ``deviation`` too
    large for a long is null. Other columns are ignored. The driver holds a matrix of the components' covariance.
    """
    vectors = keep(floored(df, vector_col, scale, LIMIT, F.col(id_col).alias("vec_id")))
    width, spark = longest(vectors), df.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    # The constant added to every x changes neither n * x - S nor the covariance, so it's left out of the sums.
    n, total, products = moments(vectors, width)
    matrix = covariance(n, total, products) if n else np.zeros((0, 0))
    values, axes = components(df, matrix, wanted)
    m = len(values)
    sent = spark.sparkContext.broadcast((axes / np.sqrt(values), total, values / max(np.trace(matrix), 1e-300)))

    def projected(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``n * x - S`` and the whitened rows."""
        apart = centred(matrix, n, sent.value[1])
        return apart, (apart / n).astype(np.float64) @ sent.value[0]

    def rows(batches_):
        for batch in batches_:
            for part, matrix in blocks(batch, width):
                apart, white = projected(matrix)
                far = [x if x < 1 << 63 else None for x in map(int, (apart * apart).sum(axis=1))]
                ids = part.column("vec_id").take(pa.array(np.repeat(np.arange(len(part)), m)))
                columns = [ids, np.tile(np.arange(1, m + 1, dtype=np.int32), len(part)), pa.array(far, pa.int64()).take(pa.array(np.repeat(np.arange(len(part)), m)))]
                columns += [white.ravel(), np.tile(sent.value[2], len(part))]
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], ["vec_id", "component", "deviation", "whitened", "explained"])

    def added(batches_):
        sums = np.zeros(m)
        for batch in batches_:
            for _, matrix in blocks(batch, width):
                sums += projected(matrix)[1].sum(axis=0)
        yield pa.RecordBatch.from_pydict({"i": np.arange(m, dtype=np.int32), "value": sums})

    mean = np.zeros(m)
    for r in vectors.mapInArrow(added, "i int, value double").groupBy("i").agg(F.sum("value").alias("value")).collect():
        mean[r["i"]] = r["value"] / n

    def spread(batches_):
        sums = np.zeros((m, m))
        for batch in batches_:
            for _, matrix in blocks(batch, width):
                off = projected(matrix)[1] - mean
                sums += off.T @ off
        i, j = np.triu_indices(m)
        yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "value": sums[i, j]})

    error = 0.0
    for r in vectors.mapInArrow(spread, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        error = max(error, abs(r["value"] / n - (r["i"] == r["j"])))
    shape = f"vec_id {kind}, component int, deviation long, whitened double, explained double"
    found = vectors.mapInArrow(rows, shape) if m else spark.createDataFrame([], shape)
    return found.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(float(error)).alias("identity_error"))
