"""Operator 10, benchmark decontamination by spaced seeds. SQL functions only.

A seed is a hash of some words of a passage: the mask says which, the others may differ. The masks
are built so that every alignment with enough equal words agrees in one of them. Documents and
benchmark items meet where a seed agrees; around each hit the two are laid side by side, and enough
equal words among ``window`` consecutive ones make the document leaked.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD, identified, keep, same

#: Benchmark seeds (16 bytes of key and place each) up to which their table is broadcast.
BROADCAST_SEEDS = 1_000_000


def word_keys(text: Column) -> Column:
    """A hash per word, lower case; white space as in the contracts."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))


def once(rows: DataFrame, name: str, column: Column) -> DataFrame:
    """Add a column behind a one-row generator: what uses it, filters included, can't copy its expression."""
    return rows.select("*", F.explode(F.array(column)).alias(name))


def masks_of(n: int, share: float) -> tuple[str, ...]:
    """Masks of which one agrees in every alignment of ``n`` words with at least ``share`` of them equal.

    The words are cut into two blocks more than words may differ: two blocks stay whole, and each
    two of them are a mask. One equal word, if that is enough, is a mask itself.
    """
    need = max(math.ceil(share * n - 1e-9), 1)
    if need > n:
        return ()
    if need == 1:
        return ("1",)
    blocks = n - need + 2
    cuts = [n * i // blocks for i in range(blocks + 1)]
    pairs = [(i, j) for i in range(blocks) for j in range(i + 1, blocks)]
    ones = lambda i: "1" * (cuts[i + 1] - cuts[i])
    return tuple(sorted({ones(i) + "0" * (cuts[j] - cuts[i + 1]) + ones(j) for i, j in pairs}))


def seeds(rows: DataFrame, masks: dict[str, Column]) -> DataFrame:
    """``*other columns, pos, seed`` for every place and mask whose condition holds; ``words`` is the array of hashes."""
    others = [c for c in rows.columns if c != "words"]
    placed = rows.select(*others, "words", F.posexplode("words").alias("pos", "first"))
    hashed = [
        F.when(
            (F.col("pos") <= F.size("words") - len(mask)) & asked,
            F.xxhash64(F.lit(mask), *(F.get("words", F.col("pos") + i) for i, bit in enumerate(mask) if bit == "1")),
        )
        for mask, asked in masks.items()
    ]
    return placed.select(*others, "pos", F.explode(F.array(*hashed)).alias("seed")).where("seed is not null")


def most_equal(equal: Column, window: int) -> Column:
    """The largest sum of ``window`` consecutive entries, of all if they are fewer."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(equal) - window + 1, F.lit(1)))
    return F.array_max(
        F.transform(starts, lambda i: F.aggregate(F.slice(equal, i, F.lit(window)), F.lit(0), lambda a, b: a + b))
    )


def overlaps(docs: DataFrame, items: DataFrame, window: int, share: float) -> DataFrame:
    """``doc_id, version, item_id, matched``: verified overlaps, best alignment of each pair.

    ``docs`` has doc_id, version, text; ``items`` item_id, words. The benchmark's seeds are
    broadcast if they are counted to be few, else both sides are shuffled by seed.
    """
    compared = F.least(F.size("words"), F.lit(window))
    lengths: dict[str, list[int]] = {}
    for (n,) in items.select(compared).distinct().collect():
        for mask in masks_of(n, share):
            lengths.setdefault(mask, []).append(n)
    by_length = {mask: compared.isin(ns) for mask, ns in sorted(lengths.items())}
    asked = seeds(items.select("item_id", "words"), by_length).withColumnRenamed("pos", "at")
    if asked.count() <= BROADCAST_SEEDS:
        asked = F.broadcast(asked)
    given = seeds(once(docs, "words", word_keys(F.col("text"))).drop("text"), dict.fromkeys(by_length, F.lit(True)))
    hits = given.join(asked, "seed").select("doc_id", "version", "item_id", (F.col("pos") - F.col("at")).alias("shift"))
    hits = keep(hits.distinct())
    hits = hits.withColumnsRenamed({"doc_id": "__id", "version": "__version"})
    on = same(F.col("doc_id"), F.col("__id")) & (F.col("version") == F.col("__version"))
    both = docs.join(hits, on).drop("__id", "__version").join(items, "item_id")
    laid = once(both, "own", word_keys(F.col("text")))
    agree = F.transform("words", lambda w, j: F.coalesce((F.get("own", F.col("shift") + j) == w).cast("int"), F.lit(0)))
    sized = once(laid, "equal", agree).select("doc_id", "version", "item_id", "equal")
    enough = F.ceil(F.lit(share) * F.least(F.size("equal"), F.lit(window)) - 1e-9)
    found = sized.where(most_equal(F.col("equal"), window) >= enough)
    matched = F.aggregate("equal", F.lit(0), lambda a, b: a + b).cast("long")
    return found.groupBy("doc_id", "version", "item_id").agg(F.max(matched).alias("matched"))


def find_leaks(
    df: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 12,
    share: float = 0.8,
) -> DataFrame:
    """``doc_id, version, item_id, matched``: documents that hold a passage of a benchmark item.

    That is: laid side by side at some place, at least ``share`` of ``window`` consecutive words
    of the item (of all, if it has fewer) equal the document's. ``matched`` counts equal words of
    the best alignment. ``version`` is a hash of the text.

    Null texts and items without an id or a word match nothing; a null id is an id like others; items that repeat a
    text are one, under the smallest id; documents that repeat id and text are one; other columns
    are ignored; empty tables give no rows.
    """
    docs = identified(df, id_col, text_col).withColumn("version", F.xxhash64("text"))
    docs = docs.where(F.col("text").isNotNull())
    items = benchmark.select(F.col(item_id_col).alias("item_id"), word_keys(F.col(item_text_col)).alias("words"))
    items = items.where(F.col("item_id").isNotNull() & (F.size("words") > 0)).groupBy("words").agg(F.min("item_id").alias("item_id"))
    return overlaps(docs, keep(items), window, share)


def leak_report(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, leaked, n_items, best_item, matched``, one row per input row."""
    found = find_leaks(df, benchmark, id_col, text_col, **options)
    best = F.min(F.struct((-F.col("matched")).alias("order"), "item_id"))
    per_doc = found.groupBy("doc_id", "version").agg(F.count("*").alias("n_items"), best.alias("best"))
    rows = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("version"))
    per_doc = per_doc.withColumnsRenamed({"doc_id": "__id", "version": "__version"})
    on = same(F.col("doc_id"), F.col("__id")) & (F.col("version") == F.col("__version"))
    return rows.join(per_doc, on, "left").select(
        "doc_id",
        F.col("n_items").isNotNull().alias("leaked"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.col("best.item_id").alias("best_item"),
        (-F.col("best.order")).alias("matched"),
    )


def without_leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that hold no passage of the benchmark, with the same columns."""
    found = find_leaks(df, benchmark, id_col, text_col, **options).select(
        F.col("doc_id").alias("__id"), F.col("version").alias("__version")
    )
    on = same(F.col(id_col), F.col("__id")) & (F.xxhash64(F.col(text_col)) == F.col("__version"))
    return df.join(found.distinct(), on, "left_anti")
