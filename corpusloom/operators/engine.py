"""Rules run over batches of texts with RE2, in time linear in the text.

Arrow's compute functions search and replace; Python sees columns, not texts. Where matches are to
be told apart, they are marked: replaced by themselves between two characters that no text of the
batch holds. Positions of all marks of a batch are then read off its one buffer of bytes at once:
which text a mark lies in, which line and which character, are binary searches in sorted offsets.
Batches are worked on in slices of a few megabytes, each handed back as it is done: that bounds the
offsets, and a worker holds one slice's copies of its texts, not a whole batch's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Tuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ..sources.shipping import ship

ship(__name__)

COUNT = pa.struct([("rule_id", pa.int32()), ("type", pa.string()), ("matches", pa.int64())])
MATCH_FIELDS = "rule_id int, type string, start long, len long, char_start long, line_no long, line_offset long, at_break boolean, text string"
MATCH = pa.struct(
    [("rule_id", pa.int32()), ("type", pa.string())]
    + [(name, pa.int64()) for name in ("start", "len", "char_start", "line_no", "line_offset")]
    + [("at_break", pa.bool_()), ("text", pa.string())]
)
LINE = pa.struct([("start", pa.int64()), ("len", pa.int64()), ("line", pa.string())])
#: Characters of private use that can be marks, four bytes each; bytes of text worked on at once.
_PRIVATE = np.concatenate([np.arange(0xF0000, 0xFFFFE), np.arange(0x100000, 0x10FFFE)])
_SLICE = 2 << 20


def compiles(pattern: str) -> str | None:
    """Why RE2 refuses a pattern; None if it takes it."""
    try:
        pc.match_substring_regex(pa.array([""]), pattern)
    except pa.ArrowInvalid as e:
        return str(e)
    return None


def matching(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(texts, pattern).fill_null(False).to_numpy(zero_copy_only=False)


class Batch:
    """Texts of one batch as rules change them, and which rules apply to which row."""

    def __init__(self, paths: pa.Array, texts: pa.Array):
        self.paths, self.texts, self.changed = paths, texts, np.zeros(len(texts), bool)
        self.named: dict[str, np.ndarray] = {}

    def hits(self, step) -> np.ndarray:
        """Rows in which the rule finds something."""
        rows = matching(self.texts, step.re2)
        if step.file_re2 and rows.any():
            if step.file_re2 not in self.named:
                self.named[step.file_re2] = matching(self.paths, step.file_re2)
            rows &= self.named[step.file_re2]
        return rows

    def marked(self, rows: np.ndarray, step) -> tuple[pa.Array, str, str]:
        """The texts of some rows with every match between two marks."""
        texts = self.texts.filter(pa.array(rows))
        opening, closing = marks(raw_of(texts)[0])
        return pc.replace_substring_regex(texts, f"({step.re2})", f"{opening}\\1{closing}"), opening, closing

    def replace(self, rows: np.ndarray, step) -> None:
        done = pc.replace_substring_regex(
            self.texts.filter(pa.array(rows)), step.re2, step.rule.replacement.replace("\\", "\\\\")
        )
        self.texts = pc.replace_with_mask(self.texts, pa.array(rows), done)
        self.changed |= rows


def raw_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one behind the other, and where each begins (and the last ends)."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def four_bytes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and code points of the characters in the planes of private use."""
    at = np.flatnonzero(raw >= 0xF3)
    b = [raw[at + i].astype(np.int64) & m for i, m in enumerate((0x07, 0x3F, 0x3F, 0x3F))]
    return at, b[0] << 18 | b[1] << 12 | b[2] << 6 | b[3]


def marks(raw: np.ndarray) -> tuple[str, str]:
    """Two characters that the bytes don't hold."""
    used = four_bytes(raw)[1]
    free = np.setdiff1d(_PRIVATE, used)[:2] if len(used) else _PRIVATE[:2]
    if len(free) < 2:
        raise _AllTaken("a text holds every character of private use: its matches can't be marked")
    return chr(free[0]), chr(free[1])


class _AllTaken(ValueError):
    pass


def slices(paths: pa.Array, texts: pa.Array, work: Callable) -> Iterator[pa.Array]:
    """``work(paths, texts)`` of slices of some megabytes, in order; one whose marks are all taken is halved."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // _SLICE)) + 1
    todo = [*zip([0, *cuts], [*cuts, len(texts)], strict=True)][::-1]
    while todo:
        a, b = todo.pop()
        try:
            done = work(paths.slice(a, b - a), texts.slice(a, b - a))
        except _AllTaken:
            if b - a < 2:
                raise
            todo += [((a + b) // 2, b), (a, (a + b) // 2)]
        else:
            yield done


def sliced(paths: pa.Array, texts: pa.Array, work: Callable) -> pa.Array:
    """All of :func:`slices` in one."""
    return pa.concat_arrays([*slices(paths, texts, work)])


def listed(rows: list[np.ndarray], parts: list[pa.StructArray], kind: pa.DataType, n: int) -> pa.Array:
    """A list per row, from items of which each part has its rows, in rising order; a row's items by part."""
    if not parts:
        return pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], kind))
    row = np.concatenate(rows)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
    items = pa.concat_arrays(parts).take(pa.array(np.argsort(row, kind="stable")))
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), items)


def _repeated(value, kind: pa.DataType, n: int) -> pa.Array:
    return pa.repeat(pa.scalar(value, kind), n)


def rewriting(steps: list, counts: bool):
    """A function of path and text: the new text (null where it is the old one) and matches by rule."""

    def work(paths: pa.Array, texts: pa.Array) -> pa.Array:
        batch, found, items = Batch(paths, texts), [], []
        for step in steps:
            rows = batch.hits(step)
            if not rows.any():
                continue
            if counts:
                marked, opening, _ = batch.marked(rows, step)
                found.append(np.flatnonzero(rows))
                n, times = len(marked), pc.count_substring(marked, opening).cast(pa.int64())
                columns = [_repeated(step.rule_id, pa.int32(), n), _repeated(step.rule.type, pa.string(), n), times]
                items.append(pa.StructArray.from_arrays(columns, fields=list(COUNT)))
            batch.replace(rows, step)
        changed = pa.array(batch.changed)
        fresh = pc.replace_with_mask(pa.nulls(len(texts), texts.type), changed, batch.texts.filter(changed))
        return pa.StructArray.from_arrays([fresh, listed(found, items, COUNT, len(texts))], ["content", "rule_counts"])

    return _udf(work, "content string, rule_counts array<struct<rule_id: int, type: string, matches: bigint>>")


def placed(before: pa.Array, marked: pa.Array, opening: str, closing: str) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Of each marked match: which text it lies in; its start, length, character, line, place in the
    line and line-end flag; and where it starts among the bytes of all texts."""
    raw, bounds = raw_of(before)
    with_marks, marked_bounds = raw_of(marked)
    at, code = four_bytes(with_marks)
    opens, closes = at[code == ord(opening)], at[code == ord(closing)]
    row = np.searchsorted(marked_bounds, opens, side="right") - 1
    earlier = np.arange(len(row)) - np.searchsorted(row, row)  # in the same text; each took eight bytes of marks
    start = opens - marked_bounds[row] - 8 * earlier
    where, head = bounds[row] + start, bounds[row]
    inner = np.flatnonzero((raw & 0xC0) == 0x80)  # bytes that begin no character
    chars = start - (np.searchsorted(inner, where) - np.searchsorted(inner, head))
    breaks = np.concatenate([[-1], np.flatnonzero(raw == 10)])
    passed, own = np.searchsorted(breaks, where), np.searchsorted(breaks, head)
    begins = np.maximum(breaks[passed - 1] + 1, head)
    at_break = (where == bounds[row + 1]) | (np.append(raw, 0)[where] == 10)
    return row, [start, closes - opens - 4, chars, passed - own + 1, where - begins, at_break], where


def cut_out(raw: np.ndarray, where: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Pieces of the bytes as texts."""
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    data = raw[np.arange(bounds[-1]) + np.repeat(where - bounds[:-1], sizes)]
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data))


def finding(steps: list, safe: bool):
    """A function of path and text: every match of every rule, on the text as it stood before the rule."""

    def work(paths: pa.Array, texts: pa.Array) -> pa.Array:
        batch, found, items = Batch(paths, texts), [], []
        for step in steps:
            rows = batch.hits(step)
            if not rows.any():
                continue
            marked, *pair = batch.marked(rows, step)
            before = batch.texts.filter(pa.array(rows))
            row, numbers, where = placed(before, marked, *pair)
            n = len(row)
            text = pa.nulls(n, pa.string()) if safe else cut_out(raw_of(before)[0], where, numbers[1])
            columns = [_repeated(step.rule_id, pa.int32(), n), _repeated(step.rule.type, pa.string(), n)]
            columns += [*map(pa.array, numbers), text]
            found.append(np.flatnonzero(rows)[row])
            items.append(pa.StructArray.from_arrays(columns, fields=list(MATCH)))
            batch.replace(rows, step)
        return pa.StructArray.from_arrays([listed(found, items, MATCH, len(texts))], ["matches"])

    return _udf(work, f"matches array<struct<{MATCH_FIELDS.replace(' ', ': ')}>>".replace(",: ", ", "))


def lines_of(texts: pa.Array) -> pa.Array:
    """Lines of each text with their byte offset and length. A line feed at the end starts no line."""
    split = pc.split_pattern(texts, "\n")
    bounds, flat = split.offsets.to_numpy(), split.flatten()
    sizes = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes + 1)])
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))
    start = ends[:-1] - ends[bounds[:-1]][row] if len(row) else ends[:-1]
    kept = np.ones(len(flat), bool)
    last = bounds[1:][np.diff(bounds) > 0] - 1
    kept[last] = sizes[last] > 0
    counts = np.bincount(row[kept], minlength=len(texts))
    items = pa.StructArray.from_arrays([pa.array(start[kept]), pa.array(sizes[kept]), flat.filter(pa.array(kept))], fields=list(LINE))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), items)


def lining():
    """A function of text: its lines."""

    def work(_, texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([lines_of(texts)], ["lines"])

    return _udf(work, "lines array<struct<start: bigint, len: bigint, line: string>>", of_text=True)


def _udf(work: Callable, kind: str, of_text: bool = False):
    """``work`` as a function of path and text (or of text alone), slice by slice."""

    def run(batches: Iterator[Tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for paths, texts in batches:
            yield from slices(paths, texts, work)
            pa.default_memory_pool().release_unused()

    def run_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run((texts, texts) for texts in batches)

    return F.arrow_udf(run_text if of_text else run, returnType=f"struct<{kind}>")
