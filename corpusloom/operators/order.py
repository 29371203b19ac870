"""Positions in a sorted order, without sorting in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import workspace
from .skew import spread_join

_AT = "__at"
#: Partitions of a block: what one task adds up on either level of the prefix sum.
BLOCK = 1024


def in_order(rows: DataFrame, order: list[Column | str], by: str | None = None, name: str = "position") -> DataFrame:
    """Number rows from 0 in an order, for each ``by`` if given: a column ``name`` is added."""
    keys = [by] if by else []
    ranged = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    return numbered(ranged, by, name)


def numbered(rows: DataFrame, by: str | None = None, name: str = "position") -> DataFrame:
    """Number rows that are sorted over partitions, from 0, for each ``by`` if given.

    The rows are written as they stand, each with its partition and its place there. Rows per
    partition (and ``by``) are counted, and the rows of earlier partitions added up: a table of one
    short row each, which the rows are joined with. Neither the plan nor the driver grows with the
    number of partitions.
    """
    spark, keys = rows.sparkSession, [by] if by else []
    folder = workspace(spark)
    rows.withColumn(_AT, F.monotonically_increasing_id()).write.parquet(folder)
    kept = spark.read.parquet(folder).withColumn("__part", F.shiftright(_AT, 33))
    sizes = kept.groupBy(*keys, "__part").agg(F.count("*").alias("__n"), F.min(_AT).alias("__first"))
    starts = before(sizes, "__part", "__n", keys, "__before").drop("__n")
    table = workspace(spark)
    starts.write.parquet(table)
    placed = spread_join(kept, spark.read.schema(starts.schema).parquet(table), [*keys, "__part"])
    place = F.col("__before") + F.col(_AT) - F.col("__first")
    return placed.withColumn(name, place).drop(_AT, "__part", "__before", "__first")


def before(sizes: DataFrame, at: str, n: str, by: list[str], name: str) -> DataFrame:
    """Add ``name``: the sum of ``n`` over all rows of smaller ``at`` (unique numbers from 0, for each ``by``).

    A two-level exclusive prefix sum: within blocks of ``BLOCK`` numbers, and over the blocks' sums.
    """
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocked = sizes.withColumn("__block", F.call_function("div", F.col(at), F.lit(BLOCK)))
    inside = F.coalesce(F.sum(n).over(earlier(Window.partitionBy(*by, "__block").orderBy(at))), F.lit(0))
    sums = blocked.groupBy(*by, "__block").agg(F.sum(n).alias("__sum"))
    over = F.coalesce(F.sum("__sum").over(earlier(Window.partitionBy(*by).orderBy("__block"))), F.lit(0))
    blocks = sums.select(*by, "__block", over.alias("__blocks_before"))
    both = blocked.withColumn("__inside", inside).join(blocks, [*by, "__block"])
    return both.select(*sizes.columns, (F.col("__blocks_before") + F.col("__inside")).alias(name))
