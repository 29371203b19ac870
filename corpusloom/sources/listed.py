"""A committed listing as a Spark data source: a filter decides before a file is opened.

``list_files`` says what there is; :func:`commit_listing` writes that as a table whose part files hold
about 128 MB of files each. Reading it, a part file is a partition: the driver sees their names only, and
the tasks open the files that filters on ``path`` and ``size`` leave.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D

from .files import _read, reading_tasks
from .shipping import ship
from .workspace import workspace

ship(__name__)

FORMAT = "corpusloom_listed_files"
#: Filters that the reader takes over, and how; others are left to Spark.
_COMPARED = {
    "EqualTo": pc.equal, "GreaterThan": pc.greater, "GreaterThanOrEqual": pc.greater_equal, "LessThan": pc.less,
    "LessThanOrEqual": pc.less_equal,
}
_TEXT = {"StringStartsWith": pc.starts_with, "StringEndsWith": pc.ends_with, "StringContains": pc.match_substring}
_ROWS = 1024


def commit_listing(listed: DataFrame, folder: str | None = None) -> str:
    """Write a listing so that each of its part files names about 128 MB of files; the folder it is in."""
    folder = folder or workspace(listed.sparkSession)
    columns = ["path", "absolute_path", "raw_path", "size"]
    listed.select(*columns).repartition(reading_tasks(listed), "absolute_path").write.parquet(folder)
    return folder


def read_listing(spark: SparkSession, folder: str) -> DataFrame:
    """``path, size, raw, read_error`` of the files of a committed listing, ready to admit.

    Conditions on ``path`` (equal, in a list, beginning, end, part) and ``size`` (comparisons) are pushed
    into the source and are tested on the listing: files that they exclude are never opened.
    """
    # Without it, Spark refuses sources that take filters.
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ListedFiles)
    return spark.read.format(FORMAT).option("listing", folder).load()


class ListedFiles(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, size bigint, raw binary, read_error string"

    def reader(self, schema) -> Reader:
        return Reader(self.options["listing"])


class Part(D.InputPartition):
    """A part file of the listing."""

    def __init__(self, file: str):
        super().__init__(file)


class Reader(D.DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.tests = folder, []

    def pushFilters(self, filters: list) -> Iterable:
        for f in filters:
            test = self._test(f)
            if test:
                self.tests.append(test)
            else:
                yield f

    def _test(self, f) -> tuple | None:
        """Name of the filter, column and value, if it is one that the listing can answer."""
        kind, column = type(f).__name__, getattr(f, "attribute", ())
        if column not in (("path",), ("size",)):
            return None
        if kind == "IsNotNull" or kind in _COMPARED or kind == "In" or kind in _TEXT and column == ("path",):
            return kind, column[0], getattr(f, "value", None)
        return None

    def partitions(self) -> list[Part]:
        system, inner = _system(self.folder)
        from pyarrow import fs

        found = system.get_file_info(fs.FileSelector(inner))
        return [Part(i.path) for i in found if i.path.endswith(".parquet")]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        from pyarrow import parquet

        system, _ = _system(self.folder)
        with system.open_input_file(partition.value) as file:
            for batch in parquet.ParquetFile(file).iter_batches(_ROWS):
                for rows in _read([batch.filter(self.kept(batch))]):
                    yield rows.select(["path", "size", "raw", "read_error"])

    def kept(self, batch: pa.RecordBatch) -> pa.Array:
        """Rows of the listing that pass all filters; where one cannot tell, as for a null, none does."""
        mask = pa.repeat(pa.scalar(True), batch.num_rows)
        for kind, name, value in self.tests:
            column = batch.column(batch.schema.get_field_index(name))
            if kind == "IsNotNull":
                found = pc.is_valid(column)
            elif kind == "In":
                found = pc.is_in(column, pa.array([v for v in value if v is not None], column.type))
            elif kind in _TEXT:
                found = _TEXT[kind](column, value)
            else:
                found = _COMPARED[kind](column, pa.scalar(value, column.type))
            mask = pc.and_(mask, pc.fill_null(found, False))
        return mask


def _system(folder: str):
    from pyarrow import fs

    if "://" in folder:
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), posixpath.abspath(folder.removeprefix("file:"))
