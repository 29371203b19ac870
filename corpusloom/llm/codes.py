"""Operator 12, compression of vectors to codes of their parts (product quantisation), in exact integers.

Each part of a vector is given its nearest entry in that part's codebook. Distances come from dot
products of integers, computed on BLAS by limbs, so equal distances are equal and ties go to the first entry.
Tasks add up their parts by entry; what is shuffled and sent to the driver is sums per entry.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import spread_join
from ..sources.shipping import ship
from .limbs import dense, dot, floored, longest
from .shared import keep

ship(__name__)

#: Rows assigned at once, and labels up to which their sums are broadcast.
AT_ONCE, BROADCAST_LABELS = 4096, 10_000


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of each point and its squared distance (wrapping sums of what fits at the end)."""
    apart = (entries * entries).sum(axis=1) - 2 * dot(points, entries)
    apart += (points * points).sum(axis=1)[:, None]
    code = apart.argmin(axis=1)
    return code, apart[np.arange(len(points)), code]


def blocks(batch: pa.RecordBatch, width: int):
    """``rows, matrix`` of a few thousand rows each."""
    for at in range(0, batch.num_rows, AT_ONCE):
        rows = batch.slice(at, AT_ONCE)
        yield rows, dense(rows.column("vector"), width)


def sums(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """``part, entry, pos, total, n``: the parts assigned to each entry, added up."""
    parts, entries, size = books.shape
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches_):
        total, n = np.zeros((parts, entries, size), np.int64), np.zeros((parts, entries), np.int64)
        held, spare = 0, np.zeros((parts, entries, size), object)
        for batch in batches_:
            for _, matrix in blocks(batch, parts * size):
                held += int(max(matrix.max(initial=0), -int(matrix.min(initial=0)))) * len(matrix)
                if held >= 1 << 62:
                    spare, held = spare + total.astype(object), 0
                    total[:] = 0
                for p in range(parts):
                    own = matrix[:, p * size : (p + 1) * size]
                    code, _ = nearest(own, sent.value[p])
                    order = np.argsort(code, kind="stable")
                    used, first, counts = np.unique(code[order], return_index=True, return_counts=True)
                    total[p, used] += np.add.reduceat(own[order], first, axis=0)
                    n[p, used] += counts
        p, e = np.nonzero(n)
        if len(p):
            whole = (spare[p, e] + total[p, e].astype(object)).ravel()
            columns = [np.repeat(p, size), np.repeat(e, size), np.tile(np.arange(size), len(p))]
            arrays = [pa.array(c.astype(np.int32)) for c in columns]
            arrays += [pa.array([str(x) for x in whole], pa.string()), pa.array(np.repeat(n[p, e], size))]
            yield pa.RecordBatch.from_arrays(arrays, ["part", "entry", "pos", "total", "n"])

    found = vectors.select("vector").mapInArrow(run, "part int, entry int, pos int, total string, n long")
    grouped = found.groupBy("part", "entry", "pos")
    return grouped.agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))


def codebooks(vectors: DataFrame, parts: int, entries: int, rounds: int, size: int) -> np.ndarray:
    """``parts x entries x size`` integers after the rounds. The driver holds sums per entry, never vectors but the first ones."""
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).select("vector")
    rows = [r["vector"] + [0] * (parts * size - len(r["vector"])) for r in first.collect()]
    books = np.array(rows, np.int64).reshape(len(rows), parts, size).transpose(1, 0, 2).copy()
    for _ in range(rounds if len(rows) else 0):
        fresh = books.copy()
        for r in sums(vectors, books).collect():
            fresh[r["part"], r["entry"], r["pos"]] = int(r["total"]) // r["n"]
        books = fresh
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all integers by part, entry and place, in decimal, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error`` of every vector."""
    parts, _, size = books.shape
    sent = vectors.sparkSession.sparkContext.broadcast(books)
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def run(batches_):
        names = [f"{i:02x}" for i in range(256)]
        for batch in batches_:
            for rows, matrix in blocks(batch, parts * size):
                found = [nearest(matrix[:, p * size : (p + 1) * size], sent.value[p]) for p in range(parts)]
                text = ["".join(names[c] for c in row) for row in zip(*(c.tolist() for c, _ in found), strict=True)]
                error = pa.array(np.sum([e for _, e in found], axis=0, dtype=np.int64))
                columns = [rows.column("vec_id"), rows.column("label"), pa.array(text, pa.string()), error]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    return vectors.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compress_vectors(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: int = 1024,
) -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256``, one row per usable vector.

    Components become floor(scale * x); vectors are cut into ``parts`` equal pieces. A codebook starts
    as that piece of the ``entries`` smallest ids and is moved ``rounds`` times to floor(mean) of what
    is nearest to each entry, ties to the first; entries without a piece stay. ``code`` has two hex
    digits per part, ``error`` the squared distances summed up, ``label_error`` their sum over a label.

    Vectors that are null or hold a null or non-finite component are left out. A null id is carried
    along and comes last when the first entries are chosen; of equal ids, the smaller vector comes
    first; repeated rows count each; with fewer rows than ``entries`` the codebooks are shorter.
    Vectors shorter than the longest one, rounded up to a multiple of ``parts``, count as continued
    with zeros. Integers too large for a distance that fits a long are set to the largest that does.
    Null labels are a label of their own; other columns are ignored; an empty table gives no rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits per part: 1 to 256 entries")
    ids = [F.col(id_col).alias("vec_id"), F.col(label_col).alias("label")]
    widest = df.agg(F.max(F.size(vector_col))).first()[0] or 0
    limit = math.isqrt(((1 << 63) - 1) // (4 * (max(widest, 0) + parts)))
    vectors = keep(floored(df, vector_col, scale, limit, *ids))
    size = longest(vectors, parts) // parts
    books = codebooks(vectors, parts, entries, rounds, size)
    found = keep(coded(vectors, books))
    key = lambda name: F.concat(F.when(F.col(name).isNull(), "-").otherwise("+"), F.coalesce(F.col(name).cast("string"), F.lit("")))
    total = F.sum(F.col("error").cast("decimal(38,0)")).cast("long")
    by_label = keep(found.groupBy(key("label").alias("__key")).agg(total.alias("label_error")))
    keyed = found.withColumn("__key", key("label"))
    if by_label.count() <= BROADCAST_LABELS:
        joined = keyed.join(F.broadcast(by_label), "__key")
    else:
        joined = spread_join(keyed, by_label, ["__key"])
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
