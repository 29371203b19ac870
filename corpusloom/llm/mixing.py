"""Operator 9, mixing sources to target weights by pivotal dependent rounding. SQL functions only.

A document's expected copies are target / size of its source. The whole part is taken; the rest, a
probability, is rounded in pairs: of two documents mass is moved at random from one to the other, in
words, until one probability is 0 or 1. That keeps every expectation and, exactly, the words taken.
Documents of one source and of like size (a power of two) meet in small groups; each group leaves one
residual, and residuals meet again in groups of residuals, a tree whose depth is the logarithm of the
largest stratum. The last residuals of a source, one per size, are set from the longest to the
shortest so that its words come nearest to the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, keep

#: Documents that meet in a group, on average.
GROUP = 64
#: Sources up to which their table is broadcast (one short row each).
FEW_SOURCES = 50_000
SALTS = 32
#: Equal rows that are told apart in one task.
REPEATS = 4096
#: Strata by length: documents of 2^i to 2^(i+1) - 1 words.
STRATA = 40


def stratum(size: Column) -> Column:
    return F.least(F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double"))), F.lit(STRATA - 1)).cast("int")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(docs: DataFrame, weights: tuple[float, ...], ratio: float, most: float) -> DataFrame:
    """``source, source_size, target, strata`` (documents by length): one row per source.

    Sources by code point, null last, get the weights in turn. Water filling: by rising cap per
    weight, a source is full if the level without it would be above it; the level of the first one
    that isn't holds for the rest.
    """
    strata = [F.count(F.when(stratum(F.col("size")) == i, 1)) for i in range(STRATA)]
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.array(*strata).alias("strata"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    listed = F.array(*(F.lit(float(w)) for w in weights))
    rows = sizes.withColumn("weight", F.get(listed, F.pmod(turn - 1, F.lit(len(weights)))))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    below = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("rank", F.row_number().over(order))
    rows = rows.withColumn("level", (F.lit(float(ratio)) * F.sum("source_size").over(every) - below) / left)
    open_ = F.when(F.col("level") < F.col("cap") / F.col("weight"), F.struct("rank", "level"))
    rows = rows.withColumn("held", F.min(open_).over(every)["level"])
    target = F.coalesce(F.least("cap", F.col("weight") * F.col("held")), F.col("cap"))
    return rows.select("source", "source_size", target.alias("target"), "strata")


def attach(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Each row with its source's columns; the table of sources is broadcast only if it is short."""
    named = sources.withColumnRenamed("source", "__source")
    if sources.count() <= FEW_SOURCES:
        on = F.col("source").eqNullSafe(F.col("__source"))
        return rows.join(F.broadcast(named), on).drop("__source")
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("tie"), F.lit(SALTS)).cast("int"))
    spread = named.withColumn("__to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = F.col("source").eqNullSafe(F.col("__source")) & (F.col("__salt") == F.col("__to"))
    return salted.join(spread, on).drop("__source", "__salt", "__to")


def pair(first: Column, second: Column, seed: int) -> Column:
    """Both items after mass is moved between them, in words, until one of them is whole."""
    x, y = first["x"], second["x"]
    ratio = second["size"] / first["size"]
    up, down = F.least(1 - x, y * ratio), F.least(x, (1 - y) * ratio)
    drawn = F.pmod(F.xxhash64(first["tie"], second["tie"], F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    rise = drawn * (up + down) < down
    inside = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    new_x = F.when(rise, F.when(1 - x <= y * ratio, 1.0).otherwise(inside(x + up))).otherwise(
        F.when(x <= (1 - y) * ratio, 0.0).otherwise(inside(x - down))
    )
    new_y = F.when(rise, F.when(1 - x >= y * ratio, 0.0).otherwise(inside(y - up / ratio))).otherwise(
        F.when(x >= (1 - y) * ratio, 1.0).otherwise(inside(y + down / ratio))
    )
    return F.struct(first.withField("x", new_x).alias("a"), second.withField("x", new_y).alias("b"))


def reduce_group(items: Column, kind: str, seed: int) -> Column:
    """``rest`` (the item that stays open) and ``done`` of a sorted array of items."""
    start = F.struct(F.get(items, F.lit(0)).alias("rest"), F.array().cast(f"array<{kind}>").alias("done"))

    def step(state: Column, item: Column) -> Column:
        moved = F.transform(F.array(pair(state["rest"], item, seed)), lambda p: settle(state, p))
        return F.get(moved, F.lit(0))

    def settle(state: Column, p: Column) -> Column:
        whole = p["a"]["x"].isin(0.0, 1.0)
        return F.struct(
            F.when(whole, p["b"]).otherwise(p["a"]).alias("rest"),
            F.concat(state["done"], F.array(F.when(whole, p["a"]).otherwise(p["b"]))).alias("done"),
        )

    return F.aggregate(F.slice(items, F.lit(2), F.size(items)), start, step)


def settle_rest(items: Column) -> Column:
    """The last residuals of a source, long ones first: one is taken only if the shorter ones can't make up
    the words that are left, and then only if that comes nearer."""
    words = F.aggregate(items, F.lit(0.0), lambda a, e: a + e["size"] * e["x"])
    all_ = F.aggregate(items, F.lit(0.0), lambda a, e: a + e["size"])
    start = F.struct(words.alias("left"), all_.alias("rest"), F.array().cast("array<double>").alias("x"))

    def step(state: Column, item: Column) -> Column:
        left, rest = state["left"], state["rest"] - item["size"]
        taken = (left > rest) & ((left >= item["size"]) | (item["size"] - left < left - rest))
        x = F.when(taken, 1.0).otherwise(0.0)
        return F.struct(
            (left - x * item["size"]).alias("left"), rest.alias("rest"), F.concat(state["x"], F.array(x)).alias("x")
        )

    chosen = F.aggregate(items, start, step)["x"]
    return F.zip_with(items, chosen, lambda e, x: e.withField("x", x))


def told_apart(rows: DataFrame) -> DataFrame:
    """``source, doc_id, own, tie, size``, one row per document again, from equal ones counted as ``n``.

    ``tie`` is ``own`` for the first of them and a hash of it and a number for the others, so equal
    documents fall into groups like any others. Many of one kind are dealt out in blocks.
    """
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("n") - 1, F.lit(REPEATS))))
    few = rows.where(F.col("n") <= REPEATS).withColumn("__block", F.lit(0).cast("long"))
    many = rows.where(F.col("n") > REPEATS).withColumn("__block", block).repartition("own", "__block")
    first = F.col("__block") * REPEATS
    each = F.explode(F.sequence(first, F.least(F.col("n"), first + REPEATS) - 1)).alias("k")
    tie = F.when(F.col("k") == 0, F.col("own")).otherwise(F.xxhash64("own", "k"))
    out = few.unionByName(many).select("source", "doc_id", "own", "size", each)
    return out.select("source", "doc_id", "own", tie.alias("tie"), "size")


def round_copies(rows: DataFrame, largest: int, seed: int) -> DataFrame:
    """``source, doc_id, own, tie, size, base, x`` with x rounded to 0 or 1. ``largest``: documents of the largest stratum."""
    item = F.struct("size", "tie", "doc_id", "own", "base", "x")
    kept = F.get("strata", stratum(F.col("size")))
    now = rows.select("source", stratum(F.col("size")).alias("stratum"), item.alias("item"), F.ceil(kept / GROUP).alias("groups"))
    kind = now.schema["item"].dataType.simpleString()
    done, level, groups = [], 0, max(1, -(-largest // GROUP))
    while True:
        slot = F.pmod(F.xxhash64(F.col("item.tie"), F.lit(seed + level)), F.col("groups")).alias("slot")
        met = now.groupBy("source", "stratum", "groups", slot).agg(F.sort_array(F.collect_list("item")).alias("items"))
        out = keep(met.select("source", "stratum", "groups", reduce_group(F.col("items"), kind, seed + level).alias("out")))
        done.append(out.select("source", F.explode("out.done").alias("item")))
        now = out.select("source", "stratum", F.col("out.rest").alias("item"), F.ceil(F.col("groups") / GROUP).alias("groups"))
        if groups == 1:
            break
        level, groups = level + 1, -(-groups // GROUP)
    last = now.groupBy("source").agg(F.sort_array(F.collect_list("item"), asc=False).alias("items"))
    total = last.select("source", F.explode(settle_rest(F.col("items"))).alias("item"))
    for part in done:
        total = total.unionByName(part)
    return total.select("source", "item.*")


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    ratio: float = 1.5,
    most: float = 2.0,
    seed: int = 9,
) -> DataFrame:
    """How often each document is taken: ``doc_id, own, size, source_size, target, copies, taken``.

    Sources by code point (null last) weigh ``weights`` in turn and share ``ratio`` times all words;
    a source gets at most ``most`` times its own, the excess is shared again. Every document gets
    the whole or next whole number of its source's expected copies. All draws are hashes of ids and texts, so
    reruns agree whatever the partitions.

    Null texts have 0 words and are taken the whole part of their source's copies; a null source is
    a source of its own; null ids and repeated rows are documents like others (``own`` is a hash of
    id and text); an empty table gives no rows; other columns are ignored.
    """
    given = df.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("own"),
        word_count(F.col(text_col)).alias("size"),
    )
    docs = keep(told_apart(keep(given.groupBy("source", "doc_id", "own", "size").agg(F.count("*").alias("n")))))
    sources = keep(targets(docs, weights, ratio, most))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = attach(docs, sources).withColumn("base", F.floor(expected).cast("int")).withColumn("x", expected - F.col("base"))
    open_ = (F.col("size") > 0) & (F.col("x") > 0)
    largest = sources.agg(F.max(F.array_max("strata"))).first()[0] or 0
    rounded = round_copies(rows.where(open_), largest, seed)
    columns = ["source", "doc_id", "own", "tie", "size", "base", "x"]
    settled = rows.where(~open_).withColumn("x", F.lit(0.0)).select(columns).unionByName(rounded.select(columns))
    copies = (F.col("base") + F.col("x")).cast("int")
    done = attach(settled, sources).withColumn("copies", copies)
    return done.select(
        "doc_id", "own", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as it is taken, with the same columns.

    Rows with equal id and text count as one document with the sum of their copies.
    """
    taken = mix_sources(docs, **options).groupBy("doc_id", "own").agg(F.sum("copies").alias("__copies")).where("__copies > 0")
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    taken = taken.select(F.col("doc_id").alias("__id"), F.col("own").alias("__tie"), "__copies")
    rows = docs.withColumn("__own", F.xxhash64(F.col(id_col), F.col(text_col))).dropDuplicates([id_col, "__own"])
    on = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__tie"))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))
    return rows.join(taken, on).withColumn("__n", each).select(*(docs[c] for c in docs.columns))
