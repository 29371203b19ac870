"""A corpus from a directory tree on a file system every executor can reach.

Plain paths go through the operating system; ``scheme://`` paths go through
Arrow's file systems. Hidden names and empty files are kept, which Spark's
``binaryFile`` source drops.
"""

from __future__ import annotations

import logging
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import normalize_path, relative_to
from ..operators.admit import DEFAULT_MAX_SIZE, worth_reading
from ..operators.ignore import (
    GIT_EXCLUDE_FILE,
    GIT_IGNORE_FILE,
    IGNORE_FILE,
    drop_ignored,
    in_repositories,
    parse_rules,
    rules_in_corpus,
)
from .shipping import ship
from .workspace import workspace

ship(__name__)

_log = logging.getLogger(__name__)

_LISTED = "absolute_path string, raw_path binary, is_dir boolean, size bigint"
#: The size of a row that only says: this directory is the top of a repository.
_REPOSITORY = -1
_BATCH_ROWS = 10_000
_BATCH_BYTES = 32 << 20
_TASK_BYTES = 128 << 20


def _names(name: str) -> tuple[str, bytes | None]:
    """A name as valid text, undecodable bytes as replacement marks, and its bytes if that changed it."""
    raw = os.fsencode(name)
    text = raw.decode("utf-8", "replace")
    return text, raw if text.encode() != raw else None


def _opened(path: str | None, raw: bytes | None) -> str | None:
    """The name to open: the bytes where the text is not the name."""
    return path if raw is None else os.fsdecode(raw)


def _kind(source: str) -> tuple[bool, int]:
    """Whether the source is a directory, and the size of a file."""
    if "://" in source:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(source)
        info = system.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(source)
        return info.type == fs.FileType.Directory, info.size or 0
    return os.path.isdir(source), os.stat(source).st_size


def _children(directory: str) -> Iterator[tuple[str, bool, int | None]]:
    """Path, whether it is a directory, and size of what a directory holds; links are followed to files only.

    The operating system gives names as a stream; sizes, which cost a call each, are left open.
    """
    if "://" in directory:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(directory)
        host = directory.removesuffix(inner)
        for info in system.get_file_info(fs.FileSelector(inner)):
            is_dir = info.type == fs.FileType.Directory
            yield host + info.path, is_dir, 0 if is_dir else info.size
        return
    with os.scandir(directory) as entries:
        for entry in entries:
            try:
                is_dir = entry.is_dir()
            except OSError as e:
                _log.warning("cannot read metadata of %s: %s", entry.path, e)
                continue
            if not (is_dir and entry.is_symlink()):
                yield entry.path, is_dir, 0 if is_dir else None


def _measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Listed files with their sizes; one that cannot be looked at is left out with a warning."""
    for batch in batches:
        paths, raws, sizes = (c.to_pylist() for c in batch.columns)
        for i, size in enumerate(sizes):
            if size is None:
                path = _opened(paths[i], raws[i])
                try:
                    sizes[i] = os.stat(path).st_size
                except OSError as e:
                    _log.warning("cannot read metadata of %s: %s", path, e)
        sized = pa.array(sizes, pa.int64())
        held = pa.RecordBatch.from_arrays([*batch.columns[:2], sized], batch.schema.names)
        yield held.filter(sized.is_valid())


def _list(batches: Iterable[pa.RecordBatch], ignore_git: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("absolute_path", pa.string()), ("raw_path", pa.binary()), ("is_dir", pa.bool_()), ("size", pa.int64())]
    )

    def batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema
        )

    rows: list = []
    for directories in batches:
        for name, raw in zip(*(c.to_pylist() for c in directories.columns)):
            directory = _opened(name, raw)
            try:
                for path, is_dir, size in _children(directory):
                    if ignore_git and os.path.basename(path) == ".git":
                        rows.append((*_names(directory), False, _REPOSITORY))
                    if is_dir and ignore_git and os.path.basename(path) == ".git":
                        # Not entered, but for the one rule file it may hold.
                        path, is_dir = os.path.join(directory, GIT_EXCLUDE_FILE), False
                        if "://" in path or not os.path.isfile(path):
                            continue
                        size = os.path.getsize(path)
                    rows.append((*_names(path), is_dir, size))
                    if len(rows) >= _BATCH_ROWS:
                        yield batch(rows)
                        rows = []
            except OSError as e:
                _log.warning("cannot list %s: %s", directory, e)
    if rows:
        yield batch(rows)


def _walk(spark: SparkSession, source: str, ignore_git: bool) -> DataFrame:
    """Every file below a directory, one level of directories after the other.

    A level's directories are listed by as many tasks as there are cores, and
    each level is a written table: nothing is listed on the driver, and a lost
    executor costs the listing of its directories only. The names of one
    directory are a stream that one task writes in pages, in bounded memory
    where the operating system lists; sizes are looked up afterwards, dealt out
    by path, so the files of one huge directory are looked at all over the cluster.
    """
    folder = workspace(spark)
    tasks = spark.sparkContext.defaultParallelism
    level = spark.createDataFrame([_names(source)], "absolute_path string, raw_path binary")
    levels = []
    while True:
        levels.append(f"{folder}/level={len(levels)}")
        spread = level.repartition(tasks, "absolute_path") if len(levels) > 1 else level
        spread.mapInArrow(lambda b: _list(b, ignore_git), _LISTED).write.parquet(levels[-1])
        level = spark.read.parquet(levels[-1]).where("is_dir").select("absolute_path", "raw_path")
        if level.isEmpty():
            break
    found = spark.read.schema(_LISTED).parquet(*levels)
    found = found.where("not is_dir").select("absolute_path", "raw_path", "size")
    if "://" in source:
        return found
    sized = f"{folder}/sized"
    found.repartition(tasks, "absolute_path").mapInArrow(_measured, found.schema).write.parquet(sized)
    return spark.read.schema(found.schema).parquet(sized)


def _rules_above(root: str) -> tuple[str, list[tuple[str, str, str]], bool]:
    """The topmost directory above a source whose rule files reach it, their (owner, kind, text),
    and whether the source lies in a repository. Rule files of version control count up to its top."""
    if "://" in root:
        return root, [], False
    found, at = [], os.path.abspath(root)
    top = at
    in_repository = os.path.exists(os.path.join(at, ".git"))
    beyond = in_repository
    while at != os.path.dirname(at):
        at = os.path.dirname(at)
        for name, kind in ((IGNORE_FILE, "ignore"), (GIT_IGNORE_FILE, "gitignore")):
            path = os.path.join(at, name)
            if os.path.isfile(path) and not (beyond and kind == "gitignore"):
                with open(path, encoding="utf-8", errors="replace") as f:
                    found.append((at, kind, f.read()))
        if os.path.exists(os.path.join(at, ".git")):
            in_repository = beyond = True
    found = [r for r in found if in_repository or r[1] == "ignore"]
    top = min((r[0] for r in found), key=len, default=top)
    owners = [os.path.relpath(a, top) for a, _, _ in found]
    return top, [("" if o == "." else o, k, t) for o, (_, k, t) in zip(owners, found)], in_repository


def list_files(
    spark: SparkSession,
    source: str,
    base: str | None = None,
    *,
    ignore_git: bool = True,
    global_rules: str | None = None,
) -> DataFrame:
    """``path, absolute_path, raw_path, size`` of every file at or below ``source``.

    ``path`` is relative to ``base`` when one is given. With ``ignore_git`` directories named
    ``.git`` are not entered and ignore files are obeyed: ``.ignore`` anywhere, those of version
    control (and the file ``global_rules``) inside repositories, and those of the directories above
    the source as well. ``raw_path`` is a name that is no valid text, in bytes, to open it by.
    """
    is_dir, size = _kind(source)
    if not is_dir:
        row = [(*_names(source), size)]
        listed = spark.createDataFrame(row, "absolute_path string, raw_path binary, size bigint")
        return _named(listed, base)
    root = source.rstrip("/") or "/"
    listed = _walk(spark, root, ignore_git)
    if not ignore_git:
        return _named(listed, base)

    # Ignore rules apply to paths below the topmost directory that has any, whatever base they show.
    top, above, in_repository = _rules_above(root)
    if above:
        from_top = os.path.relpath(os.path.abspath(root), top)
        below = listed.withColumn("path", F.concat_ws("/", F.lit(from_top), relative_to("absolute_path", root)))
    else:
        below = listed.withColumn("path", relative_to("absolute_path", root))
    repositories = below.where(F.col("size") == _REPOSITORY).select(F.col("path").alias("owner"))
    if in_repository:
        repositories = spark.createDataFrame([("",)], "owner string")
    below = below.where(F.col("size") != _REPOSITORY)
    rule_file = F.regexp_like(
        "path", F.lit(rf"(^|/)(\{IGNORE_FILE}|\{GIT_IGNORE_FILE}|\{GIT_EXCLUDE_FILE})\z")
    )
    rule_files = below.where(rule_file)
    visible = below.where(~F.endswith("path", F.lit(GIT_EXCLUDE_FILE)))
    given = [(o, k, n, line) for o, k, text in above for n, line in enumerate(text.split("\n"))]
    if global_rules:
        with open(global_rules, encoding="utf-8", errors="replace") as f:
            given += [("", "global", n, line) for n, line in enumerate(f.read().split("\n"))]
    if not given and rule_files.isEmpty():
        return _named(visible.drop("path"), base)
    held = read_files(rule_files)
    rules = rules_in_corpus(held.select("path", F.col("raw").cast("string").alias("content")))
    if given:
        lines = spark.createDataFrame(given, "owner string, kind string, line_no int, line string")
        rules = rules.unionByName(parse_rules(lines))
    rules = in_repositories(rules, repositories)
    folder = workspace(spark)
    rules.write.parquet(folder)
    rules = spark.read.schema(rules.schema).parquet(folder)
    if rules.isEmpty():
        return _named(visible.drop("path"), base)
    # Written once: what reads the listing, and counts it, shouldn't join again.
    folder = workspace(spark)
    kept = drop_ignored(visible, rules).drop("path")
    kept.write.parquet(folder)
    return _named(spark.read.schema(kept.schema).parquet(folder), base)


def _named(listed: DataFrame, base: str | None) -> DataFrame:
    shown = relative_to("absolute_path", base) if base else F.col("absolute_path")
    return listed.where(F.col("size") != _REPOSITORY).select(
        normalize_path(shown).alias("path"), "absolute_path", "raw_path", "size"
    )


def _fetch(path: str) -> bytes:
    if "://" in path:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        with system.open_input_stream(inner) as f:
            return f.read()
    with open(path, "rb") as f:
        return f.read()


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Append ``raw`` and ``read_error``; batches are cut by bytes, not rows."""

    def joined(rows: pa.RecordBatch, raw: list, errors: list) -> pa.RecordBatch:
        columns = [*rows.columns, pa.array(raw, pa.binary()), pa.array(errors, pa.string())]
        return pa.RecordBatch.from_arrays(columns, [*rows.schema.names, "raw", "read_error"])

    for batch in batches:
        paths = batch.column(batch.schema.get_field_index("absolute_path")).to_pylist()
        if "raw_path" in batch.schema.names:
            raws = batch.column(batch.schema.get_field_index("raw_path")).to_pylist()
            paths = [p if p is None else _opened(p, r) for p, r in zip(paths, raws)]
        start, held, raw, errors = 0, 0, [], []
        for at, path in enumerate(paths):
            data = error = None
            try:
                data = _fetch(path) if path is not None else None
            except OSError as e:
                error = str(e)
            raw.append(data)
            errors.append(error)
            held += len(data or b"")
            if held >= _BATCH_BYTES:
                yield joined(batch.slice(start, at + 1 - start), raw, errors)
                start, held, raw, errors = at + 1, 0, [], []
        if raw:
            yield joined(batch.slice(start), raw, errors)


def read_files(listed: DataFrame) -> DataFrame:
    """Add ``raw`` and ``read_error`` to listed files; a failed read is a row, not a failure.

    Paths are dealt out by hash over enough tasks for their total size, so the
    files of one huge directory are read all over the cluster.
    """
    return read_in_place(listed.repartition(reading_tasks(listed), "absolute_path"))


def reading_tasks(listed: DataFrame) -> int:
    """Number of tasks over which to read the listed files."""
    total = listed.agg(F.sum("size")).first()[0] or 0
    return max(listed.sparkSession.sparkContext.defaultParallelism, -(-total // _TASK_BYTES))


def read_in_place(listed: DataFrame) -> DataFrame:
    """:func:`read_files` without moving rows; a null ``absolute_path`` is not read."""
    kept = T.StructType(list(listed.schema.fields))
    return listed.mapInArrow(_read, kept.add("raw", "binary").add("read_error", "string"))


def read_corpus(
    spark: SparkSession,
    source: str,
    base: str | None = None,
    *,
    max_size: str | int = DEFAULT_MAX_SIZE,
    ignore_git: bool = True,
) -> DataFrame:
    """``path, size, raw, read_error`` of a directory tree, ready to admit.

    Only files that pass the size and extension tests are opened; the others
    come with no bytes, and admission gives them their stub.
    """
    listed = list_files(spark, source, base, ignore_git=ignore_git)
    wanted = worth_reading(max_size)
    read = read_files(listed.where(wanted)).drop("absolute_path", "raw_path")
    unread = listed.where(~wanted).select(
        "path",
        "size",
        F.lit(None).cast("binary").alias("raw"),
        F.lit(None).cast("string").alias("read_error"),
    )
    return read.unionByName(unread)


def write_files(files: DataFrame, folder: str) -> int:
    """Write ``path, raw`` rows as files below a folder that all executors share; how many there were.

    Each task writes its rows; writing one again, after a lost task, gives the same file.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        made: set = set()
        for batch in batches:
            for path, raw in zip(*(c.to_pylist() for c in batch.columns)):
                directory = os.path.dirname(f"{inner}/{path}")
                if directory not in made:
                    system.create_dir(directory, recursive=True)
                    made.add(directory)
                with system.open_output_stream(f"{inner}/{path}", compression=None) as out:
                    out.write(raw or b"")
            yield pa.RecordBatch.from_pydict({"n": [len(batch)]})

    written = files.select("path", F.col("raw").cast("binary")).mapInArrow(run, "n bigint")
    return written.agg(F.sum("n")).first()[0] or 0
