"""Admission: which files are text, and what stands in for the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import extension, path_key
from ..functions.sizes import size_bytes
from ..functions.sniffing import has_binary_extension, is_utf8, looks_binary
from ._plan import settle

DEFAULT_MAX_SIZE = "4M"
BINARY_STUB = "[binary skipped]"

# Log text of each reason that is logged.
LOGGED = {
    "binary extension": "Binary detection by extension",
    "binary content": "Binary detection by content",
    "invalid utf-8": "UTF-8 validation failed (treating as binary)",
    "stylesheet": "CSS content simplification",
}


def _oversized(max_size: str | int) -> Column:
    return F.col("size") > F.lit(size_bytes(max_size))


def flag_files(files: DataFrame, max_size: str | int = DEFAULT_MAX_SIZE) -> DataFrame:
    """Add ``is_binary`` and ``is_oversized``, from path and size alone."""
    return files.withColumns(
        {
            "is_binary": has_binary_extension(extension("path")),
            "is_oversized": _oversized(max_size),
        }
    )


def worth_reading(max_size: str | int = DEFAULT_MAX_SIZE) -> Column:
    """Predicate of the files whose bytes decide: neither oversized nor binary by name."""
    return ~_oversized(max_size) & ~has_binary_extension(extension("path"))


def admit(files: DataFrame, max_size: str | int = DEFAULT_MAX_SIZE) -> DataFrame:
    """Give every file a ``status``, a ``reason`` and its text or a stub.

    Takes ``path, size`` with ``content`` (text) or ``raw`` (bytes), and
    ``read_error`` where the source may fail to read. The first test that hits
    decides: size, extension, read error, content, encoding.
    """
    return settle(admitted(files, max_size), "status", "reason", "content")


def admitted(files: DataFrame, max_size: str | int = DEFAULT_MAX_SIZE) -> DataFrame:
    """:func:`admit` as bare projections, which keep the order of sorted rows."""
    names = files.columns
    raw = F.col("raw") if "raw" in names else F.col("content").cast("binary")
    text = raw.cast("string") if "raw" in names else F.col("content")
    failed = F.when(raw.isNull(), "no content")
    if "read_error" in names:
        failed = F.coalesce("read_error", failed)

    reason = (
        F.when(_oversized(max_size), "oversize")
        .when(has_binary_extension(extension("path")), "binary extension")
        .when(failed.isNotNull(), "read error")
        .when(looks_binary(raw), "binary content")
        .when(~is_utf8(raw), "invalid utf-8")
        .when(F.lower(extension("path")) == "css", "stylesheet")
        .otherwise("text")
    )
    status = F.coalesce(
        F.try_element_at(
            F.create_map(
                *map(F.lit, ("oversize", "oversized", "read error", "error")),
                *map(F.lit, ("text", "text", "stylesheet", "text")),
            ),
            F.col("reason"),
        ),
        F.lit("binary"),
    )
    content = (
        F.when(F.col("status") == "text", text)
        .when(
            F.col("status") == "oversized",
            F.concat(F.lit("[file too large: "), F.col("size"), F.lit(" bytes]")),
        )
        .when(
            F.col("status") == "error", F.concat(F.lit("[read error: "), failed, F.lit("]"))
        )
        .otherwise(BINARY_STUB)
    )
    kept = [c for c in names if c not in ("raw", "read_error", "content", "absolute_path", "raw_path")]
    decided = files.withColumn("reason", reason).withColumn("status", status)
    return decided.select(*kept, "status", "reason", content.alias("content"))


def admission_log(admitted_files: DataFrame) -> DataFrame:
    """``path, message`` for files whose name or bytes decided, and for stylesheets."""
    notes = F.create_map(*map(F.lit, [x for pair in LOGGED.items() for x in pair]))
    noted = admitted_files.select("path", F.try_element_at(notes, F.col("reason")).alias("note"))
    message = F.concat(F.lit("Filter applied: "), "note", F.lit(" - "), "path")
    return noted.where("note is not null").select("path", message.alias("message"))


def status_counts(admitted: DataFrame) -> DataFrame:
    """Files per status."""
    return admitted.groupBy("status").agg(F.count("*").alias("files"))


def sample_files(files: DataFrame, n: int = 5, max_size: str | int = DEFAULT_MAX_SIZE) -> DataFrame:
    """The first ``n`` files in path order, numbered from 0, with the length of their text.

    The files are taken first, by a top-n that never sorts the corpus, and only those are admitted.
    """
    first = admit(files.orderBy(path_key("path")).limit(n), max_size)
    shown = F.when(
        F.col("status") == "text",
        F.concat(F.lit("Text("), F.octet_length("content"), F.lit(" chars)")),
    ).otherwise(F.concat(F.initcap("status"), F.lit(": "), F.col("content")))
    # Only these n rows reach the single-partition numbering.
    position = F.row_number().over(Window.orderBy(path_key("path"))) - 1
    return first.select(position.alias("position"), "path", shown.alias("shown"))
