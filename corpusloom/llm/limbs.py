"""Exact integer matrix products on float64 BLAS, and vectors as tables of integers.

Integers are broken into limbs so narrow that a sum of products of two limbs stays below 2^53, where
doubles are exact. The products of limbs are put together in int64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shipping import ship

ship(__name__)


def limbs(x: np.ndarray, width: int) -> list[np.ndarray]:
    """Doubles that add up to ``x`` when the i-th is shifted by ``i * width`` bits; the last carries the sign."""
    out = []
    while True:
        if int(x.max(initial=0)) < 1 << width and int(x.min(initial=0)) >= -(1 << width):
            return [*out, x.astype(np.float64)]
        out.append((x & ((1 << width) - 1)).astype(np.float64))
        x = x >> width


def dot(a: np.ndarray, b: np.ndarray, width: int | None = None) -> np.ndarray:
    """``a @ b.T`` of int64 matrices, exact modulo 2^64."""
    if width is None:
        width = max((53 - max(a.shape[1], 1).bit_length()) // 2, 1)
    total = np.zeros((len(a), len(b)), np.int64)
    right = limbs(b, width)
    for i, x in enumerate(limbs(a, width)):
        for j, y in enumerate(right):
            if (i + j) * width < 64:
                total += (x @ y.T).astype(np.int64) << ((i + j) * width)
    return total


def dense(lists: pa.Array, width: int) -> np.ndarray:
    """A row per list, continued with zeros up to ``width``."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - (offsets[:-1] - offsets[0])[row]] = values
    return out


def floored(vectors: DataFrame, vector_col: str, scale: int, limit: int, *others: Column) -> DataFrame:
    """``*others, vector``: floor(scale * x) of each component, for vectors of finite components only.

    Integers beyond ``limit`` are set to it, so that what is summed up later fits.
    """
    x = lambda v: v.cast("double")
    finite = F.forall(vector_col, lambda v: F.coalesce(F.abs(x(v)) < float("inf"), F.lit(False)) & ~F.isnan(x(v)))
    whole = lambda v: F.floor(F.greatest(F.least(x(v) * scale, F.lit(float(limit))), F.lit(float(-limit))))
    kept = vectors.where(F.col(vector_col).isNotNull()).where(finite)
    return kept.select(*others, F.transform(vector_col, whole).cast("array<long>").alias("vector"))


def longest(vectors: DataFrame, multiple: int = 1) -> int:
    """The longest vector's length, rounded up to a multiple."""
    n = vectors.agg(F.max(F.size("vector"))).first()[0] or 0
    return -(-n // multiple) * multiple
