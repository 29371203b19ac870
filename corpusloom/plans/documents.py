"""Documents: a directory tree followed by every file, as Markdown, JSON or XML.

A document is a set of *pieces*, rows of text that concatenate to it in order.
Pieces are sorted over the whole cluster and written as they are, so no
document has to fit into one task. A document as rows is always ordered parts;
:func:`whole_documents` puts them into one cell, and fails if one doesn't fit.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.languages import fence_language
from ..functions.paths import path_key
from ..functions.sizes import byte_length, token_estimate
from ..operators.admit import DEFAULT_MAX_SIZE, admitted, worth_reading
from ..operators.order import numbered
from ..operators.rules import DEFAULT_RULES, Rule, rewritten
from ..operators.tree import ROOT_LINE, tree_lines, tree_order
from ..operators.tree import tree as tree_rows
from ..sources.files import read_in_place, reading_tasks
from ..sources.shipping import ship

ship(__name__)

# The constant parts of each format.
MARKDOWN_HEAD = "## Directory Tree\n```text\n"
MARKDOWN_TREE_END = "```\n\n---\n\n"
XML_HEAD = "<instructions>Read all code before answering.</instructions>\n\n<directory_tree>\n"
XML_TREE_END = "</directory_tree>\n\n"
JSON_HEAD = '{\n  "directory_tree": "'
JSON_TREE_END = '",\n  "files": [\n    '
JSON_BETWEEN = ",\n    "
JSON_END = "\n  ]\n}"

# Bytes of a part, and the largest document that is put into one cell.
CELL_BYTES = 16 << 20
# Bytes of cells that begin in one step, which are joined at once.
_JOINED = 2 << 20
_HEAD, _TREE, _TREE_END, _FILE, _END = range(5)


def _xml_escape(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def _json_string(text: Column, quotes: bool = True) -> Column:
    """A string as a JSON literal, with or without its quotes."""
    listed = F.to_json(F.array(text))
    edge = 1 if quotes else 2
    return F.substr(listed, F.lit(edge + 1), F.char_length(listed) - 2 * edge)


def markdown_section(path: str = "path", status: str = "status", content: str = "content") -> Column:
    """Heading and fenced text of a file; stubs stand bare. Content is not escaped."""
    fenced = F.concat(
        F.lit("```"), fence_language(path), F.lit("\n"), F.col(content), F.lit("\n```\n")
    )
    body = F.when(F.col(status) == "text", fenced).otherwise(F.col(content))
    return F.concat(F.lit("### `"), F.col(path), F.lit("`\n\n"), body, F.lit("\n\n"))


def xml_section(
    path: str = "path", status: str = "status", content: str = "content", escape: bool = False
) -> Column:
    """``<file>`` element of a file; nothing is escaped unless asked for."""
    name, text = F.col(path), F.col(content)
    if escape:
        name, text = _xml_escape(name), _xml_escape(text)
    body = F.when(F.col(status) == "text", F.concat(F.lit("\n"), text, F.lit("\n"))).otherwise(text)
    return F.concat(F.lit('<file path="'), name, F.lit('">'), body, F.lit("</file>\n\n"))


def json_record(path: str = "path", status: str = "status", content: str = "content") -> Column:
    """``{"content": …, "path": …}`` of a file, text and stub alike."""
    return F.to_json(F.struct(F.col(content).alias("content"), F.col(path).alias("path")))


class _Markdown:
    head, tree_end, end, between = MARKDOWN_HEAD, MARKDOWN_TREE_END, "", ""

    def __init__(self, escape: bool):
        pass

    def tree_line(self, line: Column, first: bool = False) -> Column:
        return F.concat(line, F.lit("\n"))

    def section(self) -> Column:
        return markdown_section()


class _Xml(_Markdown):
    head, tree_end = XML_HEAD, XML_TREE_END

    def __init__(self, escape: bool):
        self.escape = escape

    def tree_line(self, line: Column, first: bool = False) -> Column:
        return F.concat(_xml_escape(line) if self.escape else line, F.lit("\n"))

    def section(self) -> Column:
        return xml_section(escape=self.escape)


class _Json(_Markdown):
    head, tree_end, end, between = JSON_HEAD, JSON_TREE_END, JSON_END, JSON_BETWEEN

    def tree_line(self, line: Column, first: bool = False) -> Column:
        return F.concat(F.lit("" if first else "\\n"), _json_string(line, quotes=False))

    def section(self) -> Column:
        content, path = _json_string(F.col("content")), _json_string(F.col("path"))
        return F.concat(
            F.lit('{\n      "content": '), content, F.lit(',\n      "path": '), path, F.lit("\n    }")
        )


FORMATS = {"md": _Markdown, "json": _Json, "xml": _Xml}


def _format(name: str, escape: bool = False):
    """Format by name; an unknown name means Markdown."""
    return FORMATS.get(name, _Markdown)(escape)


def section(format: str = "md", escape: bool = False) -> Column:
    """Section of a file (``path, status, content``) in a format."""
    return _format(format, escape).section()


def pieces(
    corpus: DataFrame,
    *,
    by: str | None = None,
    format: str = "md",
    rules: Iterable[Rule] = DEFAULT_RULES,
    max_size: str | int = DEFAULT_MAX_SIZE,
    escape: bool = False,
    tree: str = "path",
    ordered: bool = True,
    on_bad_pattern: str = "raise",
    firsts: DataFrame | None = None,
    read_tasks: int | None = None,
) -> DataFrame:
    """Pieces of the document of each ``by`` (or of the whole corpus).

    The corpus holds texts, or is a listing of files (with ``absolute_path``):
    then only names and sizes are sorted, over ``read_tasks`` tasks, and files
    are opened once, where their section is made.

    Columns: ``by``, ``rank``, ``key``, ``tie`` (the order) and ``piece``. JSON
    records come without the commas between them, unless ``firsts`` gives the
    ``first`` key of each of a bounded number of documents. Raw rows are sorted
    before they are admitted and rewritten: the sort samples its input first,
    and that way the rules still run once.
    """
    fmt = _format(format, escape)
    keys = [by] if by else []
    files = corpus.select(*keys, "path", "size", *_payload(corpus))
    listing = "absolute_path" in corpus.columns
    [tree_key, _] = tree_order(tree)
    branches = tree_rows(files.select(*keys, "path"), by).select(
        *keys,
        F.lit(_TREE).alias("rank"),
        tree_key.alias("key"),
        (~F.col("is_dir")).cast("int").alias("tie"),
        fmt.tree_line(F.col("line")).alias("fixed"),
    )
    # The pieces that every document has once; the root line has the lowest key.
    once = [
        (_HEAD, F.lit(fmt.head)),
        (_TREE, fmt.tree_line(F.lit(ROOT_LINE), first=True)),
        (_TREE_END, F.lit(fmt.tree_end)),
    ]
    if fmt.end:
        once.append((_END, F.lit(fmt.end)))
    parts = F.array(*(F.struct(F.lit(rank).alias("rank"), text.alias("fixed")) for rank, text in once))
    roots = files.select(*keys).distinct() if by else files.sparkSession.range(1).select()
    frame = roots.select(*keys, F.inline(parts)).select(
        *keys, "rank", F.lit("").alias("key"), F.lit(0).alias("tie"), "fixed"
    )
    body = files.withColumns(
        {"rank": F.lit(_FILE), "key": path_key("path"), "tie": F.lit(0)}
    )
    if firsts is not None:
        body = body.join(firsts, by)
    rows = branches.unionByName(frame).unionByName(body, allowMissingColumns=True)
    order = [*keys, "rank", "key", "tie"]
    if ordered and listing:
        rows = rows.repartitionByRange(read_tasks or reading_tasks(corpus), *order)
        rows = rows.sortWithinPartitions(*order)
    elif ordered:
        rows = rows.orderBy(*order)
    if listing:
        opened = F.when(worth_reading(max_size), F.col("absolute_path"))
        rows = read_in_place(rows.withColumn("absolute_path", opened))
    done = rewritten(admitted(rows, max_size), rules, on_bad_pattern=on_bad_pattern)
    text = fmt.section()
    if firsts is not None:
        text = F.concat(F.when(F.col("key") != F.col("first"), fmt.between).otherwise(""), text)
    piece = F.when(F.col("rank") == _FILE, text).otherwise(F.col("fixed"))
    return done.select(*keys, "rank", "key", "tie", piece.alias("piece"))


def _payload(corpus: DataFrame) -> list[str]:
    if "absolute_path" in corpus.columns:
        return [c for c in ("absolute_path", "raw_path") if c in corpus.columns]
    return [c for c in ("raw", "content", "read_error") if c in corpus.columns]


def write_document(corpus: DataFrame, path: str, *, by: str | None = None, **options) -> None:
    """Write a document: the part files of a folder, in name order, are the document.

    With ``by`` there is one folder per value. JSON is one object as well: its beginning and all
    but the last line of the tree are under ``0-tree``, the rest under ``1-files``, and the part
    files of both folders, in name order, are the object.
    """
    keys = [by] if by else []
    if options.get("format") == "json":
        _write_json(corpus, path, by, options)
        return
    rows = pieces(corpus, by=by, **options)
    if by:
        # One folder per document needs rows in order even after Python has read them.
        rows = rows.sortWithinPartitions(by, "rank", "key", "tie")
    out = rows.select(*keys, _without_line_end("piece")).write
    (out.partitionBy(by) if by else out).text(path)


def _without_line_end(piece: str) -> Column:
    """The text writer ends each row with a line feed of its own."""
    return F.left(piece, F.char_length(piece) - 1).alias("value")


def _write_json(corpus: DataFrame, path: str, by: str | None, options: dict) -> None:
    """Lines of the tree are parted by an escaped line feed, which is what stands in the string.

    The text writer puts it behind every row, so the last line goes with the rows after it.
    """
    keys = [by] if by else []
    order = tree_order(options.get("tree", "path"))
    names = corpus.select(*keys, "path")
    place = F.struct(order[0].alias("key"), (~F.col("is_dir")).alias("leaf"))
    text = F.concat(F.when(F.col("path") == "", JSON_HEAD).otherwise(""), _json_string(F.col("line"), quotes=False))
    lines = tree_lines(names, by).select(*keys, place.alias("place"), text.alias("value"))
    last_line = lines.groupBy(*keys).agg(F.max_by(F.struct("place", "value"), "place").alias("last_line"))
    last_file = names.groupBy(*keys).agg(F.max(path_key("path")).alias("last_file"))

    def told(rows: DataFrame, one: DataFrame) -> DataFrame:
        """Rows with what is known of their document: one row per document, or a constant."""
        if by:
            return rows.join(one, by, "left")
        [row] = one.collect()
        return rows.withColumn(one.columns[0], F.lit(row[0]) if not isinstance(row[0], tuple) else _constant(one, row[0]))

    upper = told(lines, last_line).where("place != last_line.place")
    upper = upper.orderBy(*keys, "place").select(*keys, "value")
    rows = told(told(pieces(corpus, by=by, **options), last_line), last_file)
    rows = rows.where(F.col("rank") >= _TREE_END)
    comma = F.when(F.col("key") != F.col("last_file"), ",").otherwise("")
    value = (
        F.when(F.col("rank") == _TREE_END, F.concat("last_line.value", F.lit('",\n  "files": [')))
        .when(F.col("rank") == _FILE, F.concat(F.lit("    "), "piece", comma))
        .otherwise(JSON_END.removeprefix("\n"))
    )
    if by:
        rows = rows.sortWithinPartitions(by, "rank", "key", "tie")
    rows = rows.select(*keys, value.alias("value"))
    for part, name, sep in ((upper, "0-tree", "\\n"), (rows, "1-files", "\n")):
        (part.write.partitionBy(by) if by else part.write).option("lineSep", sep).text(f"{path}/{name}")


def _constant(one: DataFrame, row) -> Column:
    kind = one.schema[0].dataType.simpleString()
    return F.from_json(F.lit(json.dumps(row.asDict(True), ensure_ascii=False)), F.lit(kind))


def document_totals(corpus: DataFrame, *, by: str | None = None, **options) -> DataFrame:
    """Files, bytes and token estimate of each document, without putting it together."""
    rows = pieces(corpus, by=by, ordered=False, **options)
    sums = rows.groupBy(*([by] if by else [])).agg(
        F.count_if(F.col("rank") == _FILE).alias("files"),
        F.sum(byte_length("piece")).alias("bytes"),
    )
    commas = len(_format(options.get("format", "md")).between) * F.greatest(
        F.col("files") - 1, F.lit(0)
    )
    sums = sums.withColumn("bytes", F.col("bytes") + commas)
    return sums.withColumn("tokens", token_estimate("bytes"))


def _cut(batches: Iterable[pa.RecordBatch], by: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Join consecutive pieces of one document into cells of about ``limit`` bytes.

    A batch's pieces are cut where the document changes or a further ``limit`` is full. Cells are
    joined and handed on some megabytes at a time, so that a batch is never held twice.
    """
    for batch in batches:
        names, texts = batch.column(0), batch.column(1)
        if not len(names):
            continue
        fresh = np.ones(len(names), bool)
        fresh[1:] = pc.not_equal(names.slice(1), names.slice(0, len(names) - 1)).to_numpy(zero_copy_only=False)
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        run = np.cumsum(fresh) - 1
        full = (begins - begins[np.flatnonzero(fresh)][run]) // limit
        fresh[1:] |= full[1:] != full[:-1]
        bounds = np.append(np.flatnonzero(fresh), len(names))
        steps = begins[bounds[:-1]] // _JOINED
        turns = [0, *(np.flatnonzero(np.diff(steps)) + 1), len(steps)]
        for a, b in zip(turns, turns[1:]):
            first, own = bounds[a], pa.array(bounds[a : b + 1] - bounds[a], pa.int32())
            cells = pc.binary_join(pa.ListArray.from_arrays(own, texts.slice(first, bounds[b] - first)), "")
            yield pa.RecordBatch.from_arrays([names.take(pa.array(bounds[a:b])), cells], [by, "document"])
            del cells
        pa.default_memory_pool().release_unused()


def _pieces_in_order(corpus: DataFrame, by: str, options: dict) -> DataFrame:
    """``by, piece`` of whole documents, commas included, sorted over the cluster."""
    between = _format(options.get("format", "md")).between
    first = corpus.groupBy(by).agg(F.min(path_key("path")).alias("first")) if between else None
    text = pieces(corpus, by=by, firsts=first, **options)
    return text.select(F.col(by).cast("string").alias(by), "piece")


def numbered_pieces(corpus: DataFrame, by: str, **options) -> DataFrame:
    """``by, piece, position``: the pieces of each document, numbered from 0."""
    return numbered(_pieces_in_order(corpus, by, options), by)


def assemble(
    corpus: DataFrame, by: str, *, cell_bytes: int = CELL_BYTES, **options
) -> DataFrame:
    """``by, part, document``: the text of each document, in parts numbered from 0.

    Parts are cut from pieces sorted over the cluster once they hold ``cell_bytes`` of rewritten
    text; ordered by ``part`` they concatenate to the document. No task holds more than a batch of
    pieces, and a document has as many parts as it needs, whatever its size.
    """
    text = _pieces_in_order(corpus, by, options)
    cells = text.mapInArrow(
        lambda batches: _cut(batches, by, cell_bytes), f"{by} string, document string"
    )
    parts = numbered(cells, by, "part")
    return parts.select(by, "part", "document")


def tree_parts(
    files: DataFrame, by: str, *, cell_bytes: int = CELL_BYTES, order: str = "path"
) -> DataFrame:
    """``by, part, tree``: the tree of each ``by`` in parts numbered from 0, lines parted by line feeds.

    Ordered by ``part`` they concatenate to what :func:`.tree.tree_text` gives, whatever the size.
    """
    place = dict(zip(("__key", "__leaf"), (tree_order(order)[0], ~F.col("is_dir"))))
    feed = F.when(F.col("depth") > 0, "\n").otherwise("")
    text = F.concat(feed, "line").alias("piece")
    lines = tree_lines(files, by).select(F.col(by).cast("string").alias(by), text, *(c.alias(n) for n, c in place.items()))
    lines = lines.repartitionByRange(by, *place).sortWithinPartitions(by, *place).select(by, "piece")
    cells = lines.mapInArrow(lambda batches: _cut(batches, by, cell_bytes), f"{by} string, document string")
    return numbered(cells, by, "part").select(by, "part", F.col("document").alias("tree"))


def whole_documents(
    corpus: DataFrame, by: str, *, limit: int = CELL_BYTES, **options
) -> DataFrame:
    """``by, document``: each document as one cell. Raises if one has more than ``limit`` bytes."""
    parts = assemble(corpus, by, cell_bytes=limit, **options)
    sizes = parts.groupBy(by).agg(F.sum(byte_length("document")).alias("bytes"))
    large = sizes.where(F.col("bytes") > limit).first()
    if large:
        raise ValueError(f"document {large[by]!r} has {large['bytes']} bytes, more than {limit}")
    cells = F.array_sort(F.collect_list(F.struct("part", "document")))
    joined = F.array_join(F.transform(cells, lambda c: c["document"]), "")
    return parts.groupBy(by).agg(joined.alias("document"))
