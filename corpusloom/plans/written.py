"""Written documents as one thing: a manifest that is committed last, and byte ranges read by it.

A written document is many part files. The manifest has one row per part file: its place among the
others, its size and the byte of the document at which it begins. A folder without one holds no whole
document; with one, any range of bytes can be read, by the tasks whose files hold it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.order import before
from ..operators.skew import spread_join
from ..sources.shipping import ship
from .documents import write_document

ship(__name__)

#: The name begins with an underscore, so that readers of the folder's text pass it by.
MANIFEST = "_manifest"
CHUNK = 1 << 20
#: Beyond the number of part files that one job writes.
_FOLDER = 1 << 24
_RANGES = "document string, start bigint, length bigint"


def commit_document(corpus: DataFrame, path: str, *, by: str | None = None, **options) -> DataFrame:
    """Write a document (see :func:`.documents.write_document`), then its manifest, which is returned.

    ``document, position, file, bytes, start``: ``document`` is the value of ``by`` as text, else null.
    Files are placed by their task's number, not by the letters of their names, and empty ones are left
    out. Nothing is collected. If the job ends early there is no manifest, and what was written is no document.
    """
    spark = corpus.sparkSession
    write_document(corpus, path, by=by, **options)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = F.regexp_extract("path", rf"/{by}=([^/]*)/[^/]*$", 1) if by else F.lit(None).cast("string")
    # Folders of values have blanks and the like as %XX; a plus is a plus.
    value = F.url_decode(F.replace(named, F.lit("+"), F.lit("%2B")))
    value = F.when(named != "__HIVE_DEFAULT_PARTITION__", value)
    inner = F.when(F.contains("path", F.lit("/1-files/")), _FOLDER).otherwise(0)
    task = F.regexp_extract("path", r"/part-([0-9]+)-[^/]*$", 1).cast("bigint")
    at = (inner if options.get("format") == "json" else F.lit(0)) + task
    parts = found.select(value.alias("document"), at.alias("at"), F.col("path").alias("file"), F.col("length").alias("bytes"))
    # before() joins by its keys, where null would meet nothing.
    parts = parts.withColumn("__key", F.to_json(F.struct("document")))
    placed = before(parts, "at", "bytes", ["__key"], "start")
    rows = placed.select("document", F.col("at").alias("position"), "file", "bytes", "start")
    rows.write.parquet(f"{path}/{MANIFEST}")
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The part files of a committed document. Spark's error says so if there is no manifest."""
    return spark.read.parquet(f"{path}/{MANIFEST}")


def read_bytes(
    spark: SparkSession, path: str, start: int = 0, length: int | None = None, document: str | None = None
) -> DataFrame:
    """``start, data``: a range of a document's bytes, in pieces that concatenate to it by ``start``.

    The condition on the range is one on the manifest; only files that hold some of it are opened, and
    only the bytes asked for are read. A range beyond the end gives what there is.
    """
    if start < 0 or (length is not None and length < 0):
        raise ValueError("start and length are not negative")
    end = (1 << 62) if length is None else start + length
    parts = manifest(spark, path).where(F.col("document").eqNullSafe(F.lit(document)))
    parts = parts.where((F.col("start") < end) & (F.col("start") + F.col("bytes") > start))
    lower, upper = F.greatest(F.col("start"), F.lit(start)), F.least(F.col("start") + F.col("bytes"), F.lit(end))
    held = parts.where(lower < upper).select("file", F.col("start").alias("origin"), lower.alias("lower"), upper.alias("upper"))
    grid = F.sequence(F.call_function("div", "lower", F.lit(CHUNK)), F.call_function("div", F.col("upper") - 1, F.lit(CHUNK)))
    cells = held.select("*", F.explode(grid).alias("cell"))
    first = F.greatest(F.col("lower"), F.col("cell") * CHUNK)
    last = F.least(F.col("upper"), (F.col("cell") + 1) * CHUNK)
    wanted = cells.select(first.alias("start"), "file", (first - F.col("origin")).alias("at"), (last - first).alias("n"))
    return _fetched(wanted).select("start", "data")


def read_ranges(spark: SparkSession, path: str, ranges: DataFrame) -> DataFrame:
    """``document, start, length, part, data`` for each distinct row ``document, start, length`` of a table.

    Ranges and part files meet in cells of ``CHUNK`` bytes, by equal keys: a range costs what it covers,
    whatever the size of the document, and a cell that many ranges ask for is spread over tasks. ``part``
    is the first byte of a piece; by it the pieces of a range concatenate to its bytes. Ranges that are
    null in ``start`` or ``length``, negative, empty or behind the end give no rows.
    """
    asked = ranges.select("document", F.col("start").cast("bigint"), F.col("length").cast("bigint"))
    asked = asked.where("start >= 0 AND length > 0").distinct().withColumn("key", F.to_json(F.struct("document")))
    spans = lambda a, b: F.explode(
        F.sequence(F.call_function("div", a, F.lit(CHUNK)), F.call_function("div", b - 1, F.lit(CHUNK)))
    )
    files = manifest(spark, path).where("bytes > 0").withColumnRenamed("start", "origin")
    files = files.withColumn("key", F.to_json(F.struct("document"))).drop("document", "position")
    files = files.withColumn("cell", spans(F.col("origin"), F.col("origin") + F.col("bytes")))
    # Small files share a cell; together they are one row of it.
    files = files.groupBy("key", "cell").agg(F.collect_list(F.struct("file", "origin", "bytes")).alias("files"))
    ends = files.groupBy("key").agg(F.max("cell").alias("__last"))
    asked = spread_join(asked, ends, ["key"])
    until = F.least(F.col("start") + F.col("length"), (F.col("__last") + 1) * CHUNK)
    asked = asked.where(F.col("start") < (F.col("__last") + 1) * CHUNK).withColumn("cell", spans(F.col("start"), until))
    both = spread_join(asked.drop("__last"), files, ["key", "cell"]).select(
        "document", "start", "length", "cell", F.inline("files")
    )
    first = F.greatest(F.col("start"), F.col("origin"), F.col("cell") * CHUNK)
    last = F.least(F.col("start") + F.col("length"), F.col("origin") + F.col("bytes"), (F.col("cell") + 1) * CHUNK)
    wanted = both.where(first < last).select(
        "document", "start", "length", first.alias("part"), "file", (first - F.col("origin")).alias("at"), (last - first).alias("n")
    )
    return _fetched(wanted).select("document", "start", "length", "part", "data")


def _fetched(wanted: DataFrame) -> DataFrame:
    """Rows ``file, at, n`` with the ``n`` bytes at ``at`` of the file in ``data``; a batch has about a chunk."""
    tasks = wanted.sparkSession.sparkContext.defaultParallelism
    cells = wanted.repartition(tasks, "file", F.call_function("div", "at", F.lit(CHUNK)))
    cells = cells.sortWithinPartitions("file", "at")
    return cells.mapInArrow(_fetch, T.StructType(list(cells.schema.fields)).add("data", "binary"))


def _fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    def joined(rows: pa.RecordBatch, data: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(data, pa.binary())], [*rows.schema.names, "data"])

    name, held = None, None
    try:
        for batch in batches:
            files, at, n = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("file", "at", "n"))
            begin, size, data = 0, 0, []
            for i, file in enumerate(files):
                if file != name:
                    if held:
                        held.close()
                    # Spark writes local paths as file:/a/b; Arrow's URIs have three slashes.
                    local = file.startswith("file:")
                    system, inner = (
                        (fs.LocalFileSystem(), "/" + file.removeprefix("file:").lstrip("/"))
                        if local or "://" not in file
                        else fs.FileSystem.from_uri(file)
                    )
                    name, held = file, system.open_input_file(inner)
                data.append(held.read_at(n[i], at[i]))
                if len(data[-1]) != n[i]:
                    raise OSError(f"{file} is shorter than its manifest says")
                size += n[i]
                if size >= CHUNK:
                    yield joined(batch.slice(begin, i + 1 - begin), data)
                    begin, size, data = i + 1, 0, []
            if data:
                yield joined(batch.slice(begin), data)
    finally:
        if held:
            held.close()
