"""Joins whose key may be shared by a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def spread_join(
    rows: DataFrame, lookup: DataFrame, on: list[str], how: str = "inner", salts: int | None = None
) -> DataFrame:
    """Join many rows to a lookup with one row per key, spreading every key.

    Rows of one key are dealt over ``salts`` partitions (by default an eighth of the shuffle
    partitions, 16 at least) and each lookup row is repeated that often, so a key held by a third of
    all rows is never one task's work. The salt is a hash of the row moved on by its input
    partition: rows that are equal differ in that, and a task that is run again gives each row the
    salt it had. The lookup is narrow and unique by key, which keeps the repeats cheap. When Spark
    finds the lookup small enough to broadcast it still may.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("only joins that keep the left rows can be spread")
    if salts is None:
        salts = max(SALTS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    plain = [f.name for f in rows.schema if f.dataType.typeName() not in ("map", "variant")]
    salted = rows.withColumn("__salt", salt(plain, salts))
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
    repeated = lookup.withColumn("__salt", copies)
    return salted.join(repeated, [*on, "__salt"], how).drop("__salt")


def salt(columns: list[str], salts: int) -> Column:
    return F.pmod(F.xxhash64(*columns) + F.spark_partition_id(), F.lit(salts)).cast("bigint")
