"""From a directory tree to a written document, in one call."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.snapshots import select_subpath
from ..sources.files import list_files
from .documents import write_document


def ingest(
    spark: SparkSession,
    source: str,
    out: str,
    *,
    base: str | None = None,
    subpath: str | None = None,
    ignore_git: bool = True,
    **options,
) -> None:
    """List ``source``, admit and rewrite its files, and write the document to ``out``.

    ``subpath`` keeps the files at or under a path of the listing and fails if
    there is none. Other options are those of :func:`.documents.pieces`.
    """
    listed = list_files(spark, source, base, ignore_git=ignore_git)
    if subpath:
        listed = select_subpath(listed, subpath)
    write_document(listed, out, **options)
