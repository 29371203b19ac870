"""Operator 4, exact top-k search by a three-phase uniform threshold.

A score, the inner product, is a sum over m ranges of components, each a list of partial scores.
Phase 1 gathers the k best of every list, in every block of candidates, and scores them; the k-th
best of them all bounds a query's result from below. Phase 2 gets that cutoff with the query: a
candidate that reaches it has at least a m-th of it in some list, so entries below that are left.
Phase 3 resolves the scores of the others exactly. Queries meet candidates block by block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shipping import ship
from .shared import keep

ship(__name__)

#: Candidates and queries of a block pair, and queries scored at once.
CANDIDATES, QUERIES, AT_ONCE = 8192, 2048, 64


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``vec_id, vector`` with floor(scale * x), for ids and finite vectors only."""
    x = lambda v: v.cast("double")
    finite = F.forall(vector_col, lambda v: F.coalesce(F.abs(x(v)) < float("inf"), F.lit(False)) & ~F.isnan(x(v)))
    usable = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(finite)
    return usable.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(vector_col, lambda v: F.floor(x(v) * scale).cast("long")).alias("vector"),
    )


def matrix(table: pa.Table, column: str = "vector") -> np.ndarray:
    rows = table[column].combine_chunks()
    return rows.flatten().to_numpy().reshape(len(rows), -1)


def partial_scores(queries: np.ndarray, candidates: np.ndarray, lists: int) -> list[np.ndarray]:
    """One queries x candidates array per range of components, in exact integers (held as doubles if they fit)."""
    top = max(int(np.abs(queries).max(initial=0)), 1) * max(int(np.abs(candidates).max(initial=0)), 1)
    kind = np.float64 if top * max(queries.shape[1], 1) * lists < 1 << 53 else np.int64
    q, c = queries.astype(kind), candidates.astype(kind)
    ranges = [r for r in np.array_split(np.arange(q.shape[1]), lists) if len(r)] or [np.arange(0)]
    return [q[:, r[0] : r[-1] + 1] @ c[:, r[0] : r[-1] + 1].T if len(r) else q @ c.T for r in ranges]


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]


def search_block(candidates: pa.Table, queries: pa.Table, k: int, lists: int, with_cut: bool) -> pa.Table:
    """``query_id, query, vec_id, score``: the block's best k of what its phase looks at, per query."""
    out_q, out_k, out_c, out_s = [], [], [], []
    if len(candidates) and len(queries):
        c_ids, q_ids, keys = candidates["vec_id"].to_numpy(), queries["vec_id"].to_numpy(), queries["query"].to_numpy()
        c, q = matrix(candidates), matrix(queries)
        cuts = list(zip(queries["cut"].to_pylist(), queries["cut_id"].to_pylist(), strict=True)) if with_cut else []
        for at in range(0, len(q), AT_ONCE):
            parts = partial_scores(q[at : at + AT_ONCE], c, lists)
            for i in range(len(parts[0])):
                rows = [p[i] for p in parts]
                other = c_ids != q_ids[at + i]
                if not with_cut:
                    lists_k = [np.argpartition(-np.where(other, r, r.min()), min(k, len(r) - 1))[: k + 1] for r in rows]
                    found = np.unique(np.concatenate(lists_k))
                    found = found[other[found]]
                elif cuts[at + i][0] is None:
                    found = np.flatnonzero(other)
                else:
                    found = np.flatnonzero(np.logical_or.reduce([r * len(rows) >= cuts[at + i][0] for r in rows]) & other)
                scores = sum(r[found] for r in rows).astype(np.int64)
                if with_cut and cuts[at + i][0] is not None:
                    cut, cut_id = cuts[at + i]
                    enough = (scores > cut) | ((scores == cut) & (c_ids[found] <= cut_id))
                    found, scores = found[enough], scores[enough]
                top = best(c_ids[found], scores, k)
                out_q.append(np.full(len(top), q_ids[at + i]))
                out_k.append(np.full(len(top), keys[at + i]))
                out_c.append(c_ids[found[top]])
                out_s.append(scores[top])
    columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_q, out_k, out_c, out_s)]
    return pa.table([pa.array(x, pa.int64()) for x in columns], ["query_id", "query", "vec_id", "score"])


def search(candidates: DataFrame, queries: DataFrame, k: int, lists: int, with_cut: bool) -> DataFrame:
    """Every block of candidates against every block of queries, pairs of blocks over the cluster."""
    c_blocks = max(1, -(-candidates.count() // CANDIDATES))
    q_blocks = max(1, -(-queries.count() // QUERIES))
    place = lambda n: F.pmod(F.xxhash64("vec_id", "vector"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = candidates.withColumns({"dim": F.size("vector"), "c": place(c_blocks), "q": every(q_blocks)})
    right = queries.withColumns({"dim": F.size("vector"), "q": place(q_blocks), "c": every(c_blocks)})
    keys = ["c", "q", "dim"]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return search_block(a, b, k, lists, with_cut)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, query long, vec_id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, lists: int = 4) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest inner products, ties to smaller ids.

    Both inputs have ``vec_id`` (long) and ``vector`` (array of long). A row isn't a candidate for a
    query of its own id. Only vectors of one length are compared; a query without candidates gives
    no rows, one with fewer than k gives all. Rows that repeat an id are candidates each. Queries that
    repeat id and vector are one; those that share an id only have a ranking each. Empty tables give
    no rows. Sums must stay below 2^63.
    """
    queries = queries.dropDuplicates(["vec_id", "vector"]).withColumn("query", F.xxhash64("vec_id", "vector"))
    first = search(candidates, queries, k, lists, with_cut=False)
    cut = ranked(first, k).where(F.col("rank") == k)
    cut = cut.select(F.col("query_id").alias("vec_id"), "query", F.col("score").alias("cut"), F.col("vec_id").alias("cut_id"))
    asked = keep(queries.join(cut, ["vec_id", "query"], "left"))
    done = ranked(search(candidates, asked, k, lists, with_cut=True), k)
    return done.select("query_id", "rank", "vec_id", "score")


def neighbours(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, scale: int = 256
) -> DataFrame:
    """The rows whose id is divisible by ``every`` against all rows, components as floor(scale * x)."""
    vectors = keep(quantised(df, id_col, vector_col, scale))
    return exact_top_k(vectors, vectors.where(F.col("vec_id") % every == 0), k)
