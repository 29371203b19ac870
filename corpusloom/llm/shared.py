"""What several operators need: tables written to the shared folder, worker caches, Arrow helpers."""

from __future__ import annotations

import ctypes
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shipping import ship
from ..sources.workspace import workspace

ship(__name__)

#: A word of the contracts: a run without ASCII white space, as a Java, RE2 or Python pattern.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes that a task copies out of a batch, or puts into one, at once.
SLICE = 1 << 20


def keep(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read from there.

    This cuts the lineage: whatever is lost afterwards is read again, not computed again.
    """
    spark = df.sparkSession
    path = workspace(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors see, as a URI or a path."""
    return workspace(spark)


def identified(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only id and text, so that no other column of the input can clash with ours."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def worker_state(name: str, make, version: str = ""):
    """An object of this Python worker that outlives the task; a new ``version`` replaces the old one."""
    store = sys.modules.setdefault("corpusloom_worker_state", types.ModuleType("corpusloom_worker_state"))
    if getattr(store, name, (None,))[0] != version:
        setattr(store, name, (version, make()))
    return getattr(store, name)[1]


def only_state(*names: str) -> None:
    """Let go of what tasks of other operators have left in this Python worker: all of it but ``names``."""
    store = sys.modules.get("corpusloom_worker_state")
    others = [x for x in vars(store) if not x.startswith("__") and x not in names] if store else []
    for other in others:
        delattr(store, other)
    if others:
        give_back()


def give_back() -> None:
    """Hand freed memory to the system; allocators else keep it for this worker's tasks in later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidy(run, *names: str):
    """``run``, a function for Arrow batches, in a worker that holds nothing of other operators and gives back what it frees."""

    def tidied(batches_):
        only_state(*names)
        try:
            yield from run(batches_)
        finally:
            give_back()

    return tidied


def batches(rows: list[tuple], schema: pa.Schema):
    """Rows (tuples) as one record batch."""
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of a string column; null is the empty text."""
    return [b"" if x is None else x for x in batch.column(column).cast(pa.binary()).to_pylist()]


def slices(column: pa.Array, limit: int):
    """Ranges of rows of about ``limit`` bytes of text; a longer text is a range of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), np.int64)
    at, filled = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if filled and filled + n > limit:
            yield at, i
            at, filled = i, 0
        filled += n + 1
    if at < len(sizes):
        yield at, len(sizes)


def sliced(batches_, column: str, limit: int = SLICE):
    """The batches in slices of about ``limit`` bytes of text, so that only these are copied and worked on at once."""
    for batch in batches_:
        for a, b in slices(batch.column(column).cast(pa.binary()), limit):
            yield batch.slice(a, b - a)
