"""Operator 7, substring deduplication, in place of relative Lempel-Ziv parsing.

No longest factor is extended greedily and none is measured: repeats are windows of a fixed length, and
equal windows are found by joins on hashes. The reference is every document, indexed in blocks: around
each content-defined anchor (the word n-gram with the smallest hash in a window) lie the windows that
have it as theirs. A block whose words all stand in a block of an earlier document is a duplicate as it
is; where blocks of one anchor differ, their windows are looked up one by one. Equal windows have
equal anchors, so nothing is missed; blocks without a shared anchor are never looked at again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shipping import ship
from .shared import identified, keep, texts_of
from .words import BASE, MASK, mix, run_hashes, word_hashes

ship(__name__)

#: Windows that are handled at once, to bound memory for very long texts.
PART = 1 << 15
#: Bound of the keys that are broadcast because many rows have them.
HOT_KEYS = 1 << 16


def sums(words: np.ndarray, seed: int):
    """A function from word ranges to hashes, by prefix sums of a polynomial modulo 2^64."""
    factor = (BASE * (4 * seed + 5) | 1) & MASK
    power, back = (np.full(len(words) + 1, x, np.uint64) for x in (factor, pow(factor, -1, 1 << 64)))
    power[0] = back[0] = 1
    power, back = np.cumprod(power), np.cumprod(back)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words + np.uint64(seed)) * power[:-1])])
    return lambda a, b: mix((total[b] - total[a]) * back[a] ^ (b - a).astype(np.uint64))


def blocks(words: np.ndarray, window: int, gram: int):
    """(anchor hash, two hashes of the block's words, first window, windows) of a document's blocks."""
    found = []
    for at in range(0, len(words) - window + 1, PART):
        part = words[at : at + PART + window - 1]
        grams = run_hashes(part, gram)
        view = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1)
        anchor = view.argmin(axis=1) + np.arange(len(view))
        first = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
        count = np.diff(np.append(first, len(anchor)))
        end = first + count - 1 + window
        found.append((grams[anchor[first]], sums(part, 1)(first, end), sums(part, 2)(first, end), first + at, count))
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.uint64)] * 5


def windows(words: np.ndarray, window: int, ranges) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and two hashes of the windows in (first, windows) ranges."""
    starts = [np.arange(r["first"], r["first"] + r["windows"]) for r in ranges]
    out = []
    for s in starts:
        part = words[s[0] : s[-1] + window]
        out.append((s, sums(part, 3)(s - s[0], s - s[0] + window), sums(part, 4)(s - s[0], s - s[0] + window)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def covered(size: int, ranges, window: int) -> np.ndarray:
    """Whether each of ``size`` words lies in a window of (first, windows) ranges."""
    edge = np.zeros(size + 1, np.int64)
    for r in ranges:
        edge[r["first"]] += 1
        edge[r["first"] + r["windows"] - 1 + window] -= 1
    return np.cumsum(edge[:-1]) > 0


def parse(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """``doc_id, version, anchor, r1, r2, first, windows``: the blocks of all documents."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "version", "anchor", "r1", "r2", "first", "windows"]

    def run(batches_):
        for batch in batches_:
            own = [blocks(word_hashes(t), window, gram) for t in texts_of(batch, "text")]
            rows = pa.array(np.repeat(np.arange(len(own)), [len(b[0]) for b in own]))
            joined = [np.concatenate(x) for x in zip(*own, strict=True)] if own else [np.zeros(0, np.uint64)] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(rows),
                    batch.column("version").take(rows),
                    *(pa.array(x.view(np.int64)) for x in joined[:3]),
                    *(pa.array(x.astype(np.int32)) for x in joined[3:]),
                ],
                names,
            )

    return docs.mapInArrow(
        run, f"doc_id {kind}, version long, anchor long, r1 long, r2 long, first int, windows int"
    )


def boundary_windows(docs: DataFrame, window: int) -> DataFrame:
    """``doc_id, version, first, w1, w2`` of the windows in the column ``ranges``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches_):
        for batch in batches_:
            ranges = batch.column("ranges").to_pylist()
            own = [windows(word_hashes(t), window, r) for t, r in zip(texts_of(batch, "text"), ranges, strict=True)]
            if not own:
                continue
            rows = pa.array(np.repeat(np.arange(len(own)), [len(x[0]) for x in own]))
            first, w1, w2 = (np.concatenate(x) for x in zip(*own, strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(rows),
                    batch.column("version").take(rows),
                    pa.array(first.astype(np.int32)),
                    pa.array(w1.view(np.int64)),
                    pa.array(w2.view(np.int64)),
                ],
                ["doc_id", "version", "first", "w1", "w2"],
            )

    return docs.mapInArrow(run, f"doc_id {kind}, version long, first int, w1 long, w2 long")


def counted(rows: DataFrame, *keys: str, **more) -> DataFrame:
    """Keys that stand in rows of different documents: rows ``__n``, smallest id ``__first``, and ``more``.
    Rows of a key are added up before the shuffle."""
    found = rows.groupBy(*keys).agg(
        F.count("*").alias("__n"),
        F.min("doc_id").alias("__first"),
        F.max("doc_id").alias("__last"),
        *(c.alias(n) for n, c in more.items()),
    )
    return keep(found.where("__first < __last").drop("__last"))


def met(rows: DataFrame, found: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """Rows joined with the counted keys they have; no key's rows are one task's work.

    A key is hot that has more than one in ``HOT_KEYS`` of the counted rows, so there are fewer hot keys
    than ``HOT_KEYS`` at any size: these are broadcast, and their rows stay where they are.
    """
    limit = (found.agg(F.sum("__n")).first()[0] or 0) // HOT_KEYS
    hot = F.broadcast(found.where(F.col("__n") > limit).drop("__n"))
    others = rows.join(hot.select(*keys), list(keys), "left_anti")
    others = others.join(found.where(F.col("__n") <= limit).drop("__n"), list(keys), how)
    return rows.join(hot, list(keys)).unionByName(others)


def duplicate_spans(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """``doc_id, version, ranges``: runs of windows that stand in a document with a smaller id."""
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    parsed = keep(parse(usable, window, gram))
    # Where all blocks of an anchor are equal, there is no boundary.
    anchors = counted(parsed, "anchor", mixed=F.min("r1") != F.max("r1"))
    shared = keep(met(parsed, anchors.drop("__first"), "anchor").drop("anchor"))
    factors = met(shared, counted(shared, "r1", "r2"), "r1", "r2", how="left")
    whole = F.coalesce(F.col("doc_id") > F.col("__first"), F.lit(False))
    factors = factors.withColumn("whole", whole).where("whole or mixed")
    factors = keep(factors.select("doc_id", "version", "first", "windows", "whole"))
    # A set: rows that are repeated whole have the same ranges.
    per_doc = lambda rows: rows.groupBy("doc_id", "version").agg(
        F.collect_set(F.struct("first", "windows")).alias("ranges")
    )
    open_docs = usable.join(per_doc(factors.where("not whole")), ["doc_id", "version"])
    single = keep(boundary_windows(open_docs, window))
    found = met(single, counted(single, "w1", "w2"), "w1", "w2").where("doc_id > __first")
    runs = factors.where("whole").select("doc_id", "version", "first", "windows")
    return per_doc(runs.unionByName(found.select("doc_id", "version", "first", F.lit(1).alias("windows"))))


def remove_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = 8
) -> DataFrame:
    """Texts without the words of repeated windows: ``doc_id, n_words, n_removed, kept``.

    A window is ``window`` consecutive words of one document; a word goes if a window that covers
    it has the same words as one in a document with a smaller id. ``kept`` has the other words,
    joined by one space. Windows are judged on the input. Hashes of windows have 128 bits.

    Null texts have no words; a null id is neither smaller nor larger than another, so its text
    stays whole; rows that share an id aren't each other's source; repeated rows are all given;
    texts shorter than a window stay; other columns are ignored; an empty table gives no rows.
    """
    docs = identified(df, id_col, text_col).withColumn("version", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = duplicate_spans(docs, window, gram)

    def run(batches_):
        for batch in batches_:
            n_words, n_removed, kept = [], [], []
            for text, ranges in zip(texts_of(batch, "text"), batch.column("ranges").to_pylist(), strict=True):
                words = text.split()
                if ranges:
                    gone = covered(len(words), ranges, window)
                    left = [words[i] for i in np.flatnonzero(~gone)]
                else:
                    left = words
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_removed, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    return docs.join(spans, ["doc_id", "version"], "left").mapInArrow(
        run, f"doc_id {kind}, n_words long, n_removed long, kept string"
    )


def repeat_digests(df: DataFrame, **options) -> DataFrame:
    return remove_repeats(df, **options).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )
