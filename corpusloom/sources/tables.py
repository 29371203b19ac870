"""A corpus from rows that already hold text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import normalize_path
from ..functions.sizes import byte_length


def corpus_from_table(
    table: DataFrame, path: Column | str, content: Column | str, *keep: Column | str
) -> DataFrame:
    """``path, size, content`` from a table; ``keep`` names columns to carry along."""
    path = F.col(path) if isinstance(path, str) else path
    content = F.col(content) if isinstance(content, str) else content
    rows = table.select(
        *keep, normalize_path(path).alias("path"), content.alias("content")
    )
    return rows.withColumn("size", byte_length("content"))
