"""Operator 8, near-duplicates by HyperMinHash.

A sketch has 128 registers of 16 bits: of the smallest hash in a bucket, the count of leading zeros
and the ten bits after the first one. Four registers make one 64-bit band. Sets that share a band
meet in a group named after its smallest member; there an estimate of the Jaccard similarity,
corrected for chance collisions of registers, drops members without a likely partner, and the full
shingle sets of the others decide. Components of the links follow by star contraction.

Registers per hash function grow with the set (``size class``), so that a band always stands for
several shingles: small sets get more hash functions instead of empty registers. A set also carries
the sketch of the class that a set up to ``1/similarity`` times larger may have, so both meet.
At a similarity of 0.8, 32 bands of 4 miss a pair with a chance of (1 - 0.8^4)^32 = 5e-8.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shipping import ship
from .shared import SLICE, give_back, identified, keep, only_state, sliced, texts_of, tidy
from .words import STATE, mix, run_hashes, word_hashes

ship(__name__)

REGISTERS, BAND, MANTISSA = 128, 4, 10
#: Chance that two registers over different elements agree, for sets of equal size, times 2^MANTISSA.
CHANCE = 0.34
#: Standard deviations that an estimate may lie below the threshold before a pair is given up.
SLACK = 6.0
#: Members, and shingles of all members, that one task compares at once.
GROUP_ROWS, GROUP_SHINGLES = 1024, 1 << 22
SEEDS = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles, A-Z lower-cased; the whole text if it has fewer words."""
    words = word_hashes(text.lower())
    if 0 < len(words) < k:
        return run_hashes(words, len(words), seed=len(words))
    return np.unique(run_hashes(words, k))


def size_classes(n: int, similarity: float) -> list[int]:
    """Classes of a set of n and of the largest set it can be similar to. Those from 9 on are one."""
    of = lambda x: min(9, x.bit_length() - 1)
    return list(range(of(n), of(int(n / similarity + 1e-9)) + 1))


def sketch(items: np.ndarray, size_class: int) -> np.ndarray:
    """128 registers, 0 where a bucket is empty."""
    m = min(max(1 << max(size_class - 2, 0), BAND), REGISTERS)
    t = REGISTERS // m
    h = mix(items[None, :] + SEEDS[:t, None])
    slot = (h & np.uint64(m - 1)).astype(np.int64) + m * np.arange(t)[:, None]
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(low, slot.ravel(), ((h >> np.uint64(11)) | np.uint64(1)).ravel())
    filled = low != np.iinfo(np.uint64).max
    fraction, exponent = np.frexp(np.where(filled, low, 1).astype(np.float64))
    zeros, rest = 53 - exponent, ((2 * fraction - 1) * (1 << MANTISSA)).astype(np.int64)
    return np.where(filled, (zeros + 1) << MANTISSA | rest, 0).astype(np.uint16)


def sketched(docs: DataFrame, k: int, similarity: float) -> DataFrame:
    """``doc_id, n, s1, s2, sketches``: set size, a 128-bit hash of the set, bands by size class."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    item = pa.struct([("c", pa.int32()), ("bands", pa.list_(pa.int64()))])

    def run(batches_):
        for batch in sliced(batches_, "text"):
            n, s1, s2, found = [], [], [], []
            for text in texts_of(batch, "text"):
                items = shingles(text, k)
                n.append(len(items))
                s1.append(int(np.sum(mix(items ^ np.uint64(0xA5A5A5A5)), dtype=np.uint64).view(np.int64)))
                s2.append(int(np.sum(mix(items ^ np.uint64(0x3C3C3C3C3C)), dtype=np.uint64).view(np.int64)))
                found.append(
                    [
                        {"c": c, "bands": sketch(items, c).view(np.int64)}
                        for c in (size_classes(len(items), similarity) if len(items) else ())
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n, pa.int64()),
                    pa.array(s1, pa.int64()),
                    pa.array(s2, pa.int64()),
                    pa.array(found, pa.list_(item)),
                ],
                ["doc_id", "n", "s1", "s2", "sketches"],
            )

    return docs.mapInArrow(
        tidy(run, STATE), f"doc_id {kind}, n long, s1 long, s2 long, sketches array<struct<c: int, bands: array<bigint>>>"
    )


def likely(sketches: np.ndarray, sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Whether each row has another one whose estimated similarity doesn't rule a link out."""
    found = np.zeros(len(sketches), bool)
    for i in range(len(sketches)):
        if found[i]:
            continue
        used = ((sketches != 0) | (sketches[i] != 0)).sum(axis=1)
        equal = ((sketches == sketches[i]) & (sketches[i] != 0)).sum(axis=1)
        ratio = np.minimum(sizes, sizes[i]) / np.maximum(sizes, sizes[i])
        chance = CHANCE / (1 << MANTISSA) * 4 * ratio / (1 + ratio) ** 2
        estimate = (equal / used - chance) / (1 - chance)
        fit = estimate >= similarity - SLACK * np.sqrt(similarity * (1 - similarity) / used)
        fit[i] = False
        found |= fit
        found[i] = fit.any()
    return found


def union(sets: list[np.ndarray], percent: int, probes: list[int]) -> list[int]:
    """A root per set: sets in one component of the links between ``probes`` and all sets.

    Row 0 is compared with all others first. What is in its component then needs no comparison of
    its own; every other probe is compared with all.
    """
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    size = np.array([len(s) for s in sets])
    bounds = np.concatenate([[0], np.cumsum(size)])
    distinct = np.concatenate(sets)
    distinct.sort()
    distinct = distinct[np.concatenate([[True], distinct[1:] != distinct[:-1]])]
    ids = np.empty(bounds[-1], np.int32 if len(distinct) < 1 << 31 else np.int64)
    for s, a, b in zip(sets, bounds[:-1], bounds[1:], strict=True):
        ids[a:b] = np.searchsorted(distinct, s)
    flag = np.zeros(len(distinct), bool)
    del distinct
    for i in [0, *(p for p in probes if p)]:
        if i and find(i) == find(0):
            continue
        own = ids[bounds[i] : bounds[i + 1]]
        flag[own] = True
        both = np.add.reduceat(flag[ids], bounds[:-1], dtype=np.int64)
        flag[own] = False
        for j in np.flatnonzero(100 * both >= percent * (size + size[i] - both)):
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    return [find(i) for i in range(len(sets))]


def placed(batches_, keys: list[str], k: int):
    """The full set of each document of ``doc_id, text, places`` once for each place, in batches of about ``SLICE`` bytes."""
    for batch in sliced(batches_, "text"):
        texts, listed = texts_of(batch, "text"), batch.column("places")
        index = np.repeat(np.arange(len(texts)), np.diff(listed.offsets.to_numpy()))
        sets = [shingles(t, k).tobytes() for t in texts]
        items, flat = pa.array(sets, pa.binary()), listed.flatten()
        held = np.cumsum(np.array([len(s) for s in sets], np.int64)[index])
        at = 0
        while at < len(index):
            end = max(at + 1, int(np.searchsorted(held, (held[at - 1] if at else 0) + SLICE, "right")))
            part, own = flat.slice(at, end - at), pa.array(index[at:end])
            yield pa.RecordBatch.from_arrays(
                [*(part.field(key) for key in keys), batch.column("doc_id").take(own), items.take(own)],
                [*keys, "rep", "items"],
            )
            at = end


def set_rows(docs: DataFrame, places: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The full shingle set of each rep for each of its places: ``*keys, rep, items``."""
    kinds = {f.name: f.dataType.simpleString() for f in places.schema}
    where = places.groupBy("rep").agg(F.collect_list(F.struct(*keys)).alias("places"))
    rows = docs.join(where.withColumnRenamed("rep", "doc_id"), "doc_id").select("doc_id", "text", "places")
    schema = ", ".join(f"{key} {kinds[key]}" for key in [*keys, "rep"]) + ", items binary"
    return rows.mapInArrow(tidy(lambda batches_: placed(batches_, keys, k), STATE), schema)


def linked(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Per group: ``*keys, rep, root, with_first``; the first row is the one marked ``lead``."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(table: pa.Table) -> pa.Table:
        only_state(STATE)
        order = pc.sort_indices(table.select(["lead", "rep"]), [("lead", "descending"), ("rep", "ascending")])
        items, held, table = table["items"], table.nbytes, table.drop_columns(["items"]).take(order)
        sets = [np.frombuffer(items[i].as_buffer(), np.uint64) for i in order.to_pylist()]
        probes = np.flatnonzero(table["probe"].to_numpy(zero_copy_only=False)).tolist()
        roots = union(sets, percent, probes)
        if held > 8 * SLICE:
            give_back()
        return pa.table(
            [
                *(table[key] for key in keys),
                table["rep"],
                table["rep"].take(pa.array(roots)),
                pa.array([r == 0 for r in roots]),
            ],
            [*keys, "rep", "root", "with_first"],
        )

    schema = ", ".join(f"{key} {kinds[key]}" for key in [*keys, "rep"]) + f", root {kinds['rep']}, with_first boolean"
    return rows.groupBy(*keys).applyInArrow(run, schema)


def candidate_groups(reps: DataFrame, similarity: float) -> DataFrame:
    """``c, label, rep, n, bands, blocks``: the members of every group of two sets or more.

    A band's label is its smallest rep; most bands of a group of copies agree on it, so the pairs
    (label, rep) are few. The smallest is found by combining aggregates, and the hot bands of the
    join are split by the adaptive planner.
    """
    slots = reps.select("rep", F.inline("sketches")).select("rep", "c", F.posexplode("bands").alias("band", "key"))
    slots = slots.where("key != 0").select("rep", (F.col("c") * 32 + F.col("band")).cast("short").alias("slot"), "key")
    label = slots.groupBy("slot", "key").agg(F.min("rep").alias("label"), F.max("rep").alias("last"))
    met = slots.join(label.where("label < last").drop("last"), ["slot", "key"])
    met = keep(met.select(F.shiftright("slot", 5).alias("c"), "label", "rep").distinct())
    sizes = reps.select("rep", "n", F.inline("sketches"))
    members = met.join(sizes, ["c", "rep"])
    load = members.groupBy("c", "label").agg(F.count("*").alias("rows"), F.sum("n").alias("held"))
    blocks = F.greatest(F.ceil(F.col("rows") / GROUP_ROWS), F.ceil(F.col("held") / GROUP_SHINGLES)).cast("int")
    return members.join(load.select("c", "label", blocks.alias("blocks")), ["c", "label"])


def drop_unlikely(members: DataFrame, similarity: float) -> DataFrame:
    """Members of one-block groups with a likely partner by the corrected estimate: ``c, label, rep``."""
    kind = members.schema["rep"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        only_state(STATE)
        bands = table["bands"].combine_chunks()
        rows = bands.flatten().to_numpy().view(np.uint16).reshape(len(bands), REGISTERS)
        fit = likely(rows, table["n"].to_numpy(), similarity)
        return table.select(["c", "label", "rep"]).filter(pa.array(fit))

    return members.groupBy("c", "label").applyInArrow(run, f"c int, label {kind}, rep {kind}")


def links(docs: DataFrame, reps: DataFrame, k: int, similarity: float) -> DataFrame:
    """``a, b``: edges that connect exactly what links of at least ``similarity`` connect.

    Groups beyond one block are compared block by block, each with the group's label in it; members
    that don't hang together with the label are then compared with all other blocks as well.
    """
    percent, keys = math.ceil(100 * similarity - 1e-9), ["c", "label", "block"]
    members = keep(candidate_groups(reps, similarity).withColumn("c", F.col("c").cast("int")))
    small = drop_unlikely(members.where("blocks = 1"), similarity).withColumn("block", F.lit(0))
    large = members.where("blocks > 1").drop("n", "bands").distinct()
    spread = F.when(F.col("rep") == F.col("label"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    )
    dealt = large.withColumn("block", F.explode(spread))
    own = small.unionByName(dealt.drop("blocks"))
    marked = set_rows(docs, own, keys, k).withColumns({"lead": F.expr("rep = label"), "probe": F.lit(True)})
    first = keep(linked(marked, keys, percent))
    edges = first.where("rep != root").select(F.col("rep").alias("a"), F.col("root").alias("b"))
    if large.isEmpty():
        return edges
    apart = first.where("not with_first").join(large, ["c", "label", "rep"]).drop("root", "with_first")
    count = apart.groupBy("c", "label").agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("parts"))
    probes = apart.join(count, ["c", "label"]).withColumn("part", F.pmod(F.xxhash64("rep", "c"), F.col("parts")).cast("int"))
    asked = probes.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = asked.where("other != block").select("c", "label", "rep", F.col("other").alias("block"), "part", F.lit(True).alias("probe"))
    facing = dealt.join(count, ["c", "label"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    facing = facing.select("c", "label", "rep", "block", "part", F.lit(False).alias("probe"))
    wide = [*keys, "part"]
    both = set_rows(docs, asked.unionByName(facing), [*wide, "probe"], k).withColumn("lead", F.lit(False))
    more = linked(both, wide, percent).where("rep != root")
    return edges.unionByName(more.select(F.col("rep").alias("a"), F.col("root").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node of each node's component, for nodes that aren't it.

    Alternating star contraction: every node hangs its larger neighbours, then its smaller ones, on
    the smallest; the number of rounds is logarithmic. Minima combine before the shuffle, and hubs
    are only joined with their own minimum, never gathered.
    """
    now = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.where("a != b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(down, "a").select(
            F.inline(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct("a", F.col("low").alias("b"))))
        )
        now = keep(small.where("a != b").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row per input row.

    Documents are linked if their sets of k-word shingles (A-Z lower-cased) have at least that
    Jaccard similarity, decided on the full sets; the component's id is its smallest document id,
    and that document is kept. Equal sets are one vertex, so copies are never compared.

    Null texts and texts without words have an empty set and are linked with nothing; fewer than k
    words are one shingle. A row with a null id takes no part: its component is null and it is
    kept. Rows that share an id are one vertex. An empty table gives no rows.
    """
    docs = identified(df, id_col, text_col)
    rows = keep(sketched(docs, k, similarity))
    real = rows.where("n > 0 and doc_id is not null")
    named = real.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"))
    reps = real.join(named.withColumn("doc_id", F.col("rep")), ["doc_id", "s1", "s2"]).select("rep", "n", "sketches")
    reps = keep(reps)
    found = links(docs.where("doc_id is not null"), reps, k, similarity)
    in_set = real.select("doc_id", "s1", "s2").join(named, ["s1", "s2"])
    shared = in_set.where("doc_id != rep").join(reps.select(F.col("rep").alias("doc_id")).distinct(), "doc_id")
    roots = components(found.unionByName(shared.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))
    place = named.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    place = place.select("s1", "s2", F.coalesce("root", "rep").alias("component"))
    done = rows.drop("sketches").join(place, ["s1", "s2"], "left")
    component = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id"))
    return done.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))
    )


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each component the document with the smallest id.

    Of rows that share that id one stays; rows with a null id all stay.
    """
    found = near_duplicates(df, id_col, text_col, **options)
    chosen = found.where("kept and doc_id is not null").select(F.col("doc_id").alias("__id")).distinct()
    rows = df.join(chosen, F.col(id_col) == F.col("__id"), "left_semi").dropDuplicates([id_col])
    return rows.unionByName(df.where(F.col(id_col).isNull()))
