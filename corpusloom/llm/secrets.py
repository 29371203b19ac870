"""Operator 1, secret scan: keyword automaton, patterns anchored at its hits, checksums."""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shipping import ship
from .shared import identified, texts_of, worker_state

ship(__name__)

#: Kinds in the order that breaks ties of a start. The first three are the base.
KINDS = ("assign", "access", "hex", "github", "npm")
#: Words that every match begins with, in lower case. hex has none: its pattern is a plain run.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
}
ANCHORED = {
    "assign": re.compile(
        rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE
    ),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "github": re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "npm": re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
}
HEX = re.compile(rb"[0-9a-f]{24,}")
DIGITS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum(payload: bytes) -> bytes:
    """The six base-62 digits that such tokens end with: CRC-32 of what is between prefix and them."""
    n, out = zlib.crc32(payload), b""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = DIGITS[d : d + 1] + out
    return out


def holds(kind: str, match: re.Match) -> bool:
    if kind == "assign":
        return len(match[2]) >= 6
    if kind == "access":
        return len(match[0]) >= 20
    return checksum(match[0][4:-6]) == match[0][-6:]


def automaton():
    import ahocorasick

    made = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            made.add_word(word, (kind, len(word)))
    made.make_automaton()
    return made


def spans(data: bytes, words) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of every secret, in bytes, sorted.

    Per kind, matches are the leftmost ones that don't overlap: a pattern is tried only where the
    automaton found one of its first words, and not inside the match before it, valid or not.
    """
    hits: dict[str, list[int]] = {}
    for last, (kind, size) in words.iter(data.lower().decode("latin-1")):
        hits.setdefault(kind, []).append(last + 1 - size)
    found = [(m.start(), 2, m.end()) for m in HEX.finditer(data)]
    for kind, starts in hits.items():
        free = 0
        for at in sorted(starts):
            if at >= free and (m := ANCHORED[kind].match(data, at)):
                free = m.end()
                if holds(kind, m):
                    found.append((at, KINDS.index(kind), free))
    return sorted(found)


def code_points(data: bytes, found: list[tuple[int, int, int]]) -> list[dict]:
    """Byte positions as code points. A match is ASCII, so only what is before it needs counting."""
    plain, at, points, out = data.isascii(), 0, 0, []
    for start, kind, end in found:
        if plain:
            first = start
        else:
            points += len(data[at:start].decode())
            at, first = start, points
        out.append({"kind": KINDS[kind], "start": first, "end": first + end - start})
    return out


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, secrets`` (kind, start, end in code points, by start and kind), one row per input row.

    One automaton over the lower-cased bytes finds the keywords; a pattern runs only at a hit of
    its own keywords; what has an embedded checksum is dropped where that is wrong. Nothing is
    shuffled. Null and empty texts have no secrets; ids may be null or repeat; other columns are
    ignored; an empty table gives no rows.
    """
    docs = identified(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches_):
        words = worker_state("secret keywords", automaton)
        for batch in batches_:
            rows = [code_points(t, spans(t, words)) if t else [] for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(rows, pa.list_(item))], ["doc_id", "secrets"]
            )

    return docs.mapInArrow(run, f"doc_id {kind}, secrets array<struct<kind: string, start: bigint, end: bigint>>")


def joined(secrets: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_digests(df: DataFrame, **columns) -> DataFrame:
    """Counts by kind, a digest of the base spans, and all spans as text."""
    found = find_secrets(df, **columns)
    count = lambda *kinds: F.size(F.filter("secrets", lambda s: s["kind"].isin(*kinds))).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        count(*KINDS[3:]).alias("n_checked"),
        F.sha2(joined(F.filter("secrets", lambda s: s["kind"].isin(*KINDS[:3]))), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )
