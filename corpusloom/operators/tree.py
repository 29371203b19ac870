"""Directory tree of a set of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, depth, file_name, parent, path_key

ROOT_LINE = "+ ."
#: The largest tree that is put into one cell.
TEXT_BYTES = 16 << 20


def directories(files: DataFrame, by: str | None = None) -> DataFrame:
    """Distinct directories above the files, per ``by`` if given.

    Files fold into the distinct directories that hold them first, within each
    task before the shuffle, so a directory with most of the files costs one
    row per task, and only those directories are taken apart into ancestors.
    """
    keys = [by] if by else []
    above = parent("path")
    above = F.when((above == "") & F.startswith("path", F.lit("/")), "/").otherwise(above)
    holders = files.select(*keys, above.alias("path")).where("path <> ''").distinct()
    chain = F.filter(F.concat(ancestors("path"), F.array("path")), lambda p: p != ".")
    return holders.select(*keys, F.explode(chain).alias("path")).distinct()


def tree(files: DataFrame, by: str | None = None) -> DataFrame:
    """Rows of the tree: ``path, is_dir, depth, name, line``.

    Every directory once, every file as often as it is listed. The root line
    is added by :func:`tree_lines`.
    """
    keys = [by] if by else []
    dirs = directories(files, by).withColumn("is_dir", F.lit(True))
    leaves = files.select(*keys, "path").withColumn("is_dir", F.lit(False))
    level, name = depth("path"), file_name("path")
    named = F.when(name == "", F.col("path")).otherwise(name)
    mark = F.when(F.col("is_dir"), "+ ").otherwise("- ")
    return dirs.unionByName(leaves).select(
        *keys,
        "path",
        "is_dir",
        level.alias("depth"),
        named.alias("name"),
        F.concat(F.expr("repeat('  ', depth - 1)"), mark, F.col("name")).alias("line"),
    )


def tree_order(order: str = "path") -> list:
    """Sort columns of tree rows.

    ``path`` compares whole path strings, which may list a sibling such as
    ``src-x`` between a directory and its children; ``component`` keeps children
    right under their directory.
    """
    if order not in ("path", "component"):
        raise ValueError("order is 'path' or 'component'")
    key = F.col("path") if order == "path" else path_key("path")
    return [key, F.desc("is_dir")]


def tree_lines(files: DataFrame, by: str | None = None) -> DataFrame:
    """Tree rows with the root line, which has the empty path and so sorts first."""
    keys = [by] if by else []
    rows = tree(files, by)
    if by:
        roots = files.select(by).distinct()
    else:
        roots = files.sparkSession.range(1).select()
    root = roots.select(
        *keys,
        F.lit("").alias("path"),
        F.lit(True).alias("is_dir"),
        F.lit(0).alias("depth"),
        F.lit(".").alias("name"),
        F.lit(ROOT_LINE).alias("line"),
    )
    return root.unionByName(rows)


def tree_text(files: DataFrame, by: str, order: str = "path", limit: int = TEXT_BYTES) -> DataFrame:
    """``by, tree``: the tree of each ``by`` as one text, lines parted by line feeds.

    Sizes are added up first: if a tree has more than ``limit`` bytes this raises, and
    :func:`tree_lines` or :func:`.documents.tree_parts` give it.
    """
    [key, _] = tree_order(order)
    lines = tree_lines(files, by)
    sizes = lines.groupBy(by).agg(F.sum(F.octet_length("line") + 1).alias("bytes"))
    large = sizes.where(F.col("bytes") > limit).first()
    if large:
        raise ValueError(f"the tree of {large[by]!r} has {large['bytes']} bytes, more than {limit}")
    cell = F.struct(key.alias("key"), (~F.col("is_dir")).alias("leaf"), "line")
    ordered = F.array_sort(F.collect_list(cell))
    return lines.groupBy(by).agg(
        F.array_join(F.transform(ordered, lambda c: c["line"]), "\n").alias("tree")
    )
