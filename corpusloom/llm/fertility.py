"""Operator 11, quality rules: word counts, repeats, and how a public vocabulary fares on a text.

A vocabulary with byte fallback is a yardstick made elsewhere: text like what it was made from takes few
tokens, few of them bytes, and many different ones. Characters per token, the share of byte
tokens and the entropy of a text's tokens are held against bands of its script; a value outside rejects it.

Texts are cut into pre-tokens that no merge reaches across. A batch's distinct pre-tokens are encoded
once, or found in the worker's cache; counts of all texts of a batch then come from array operations.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shipping import ship
from .shared import identified, slices, worker_state
from .tokens import SEGMENT, SPACE, separable
from .words import mix, run_hashes, word_hashes

ship(__name__)

SYMBOLS = b"#*$%&|<>"
#: Words of a window, fewest words, and percent of words in repeated windows that pass.
WINDOW, FEWEST, REPEATED = 8, 20, 30
#: Bytes of text worked on at once (a longer text is worked on alone), and words a worker remembers.
SLICE, ROOM = 1 << 22, 1 << 18


@dataclass(frozen=True)
class Band:
    """What passes: characters per token from and to, share of byte tokens up to, entropy in bits from.

    ``entropy`` holds from ``tokens`` tokens on; shorter texts need its share log2(n) / log2(tokens).
    """

    low: float
    high: float
    bytes: float
    entropy: float
    tokens: int = 256


#: Scripts by the lead byte of their letters in UTF-8; a text's script is that of most of its letters.
SCRIPTS = {
    "latin": [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)],
    "greek": [0xCD, 0xCE, 0xCF],
    "cyrillic": [*range(0xD0, 0xD5)],
    "semitic": [*range(0xD6, 0xDD)],
    "south_asian": [0xE0],
    "east_asian": [*range(0xE3, 0xEE)],
}
#: Bands by script. The vocabulary knows Latin and Cyrillic words, but letters or bytes of most others.
BANDS = {
    "latin": Band(1.9, 8.0, 0.15, 4.0),
    "greek": Band(0.7, 6.0, 0.35, 3.0),
    "cyrillic": Band(1.2, 8.0, 0.25, 4.0),
    "semitic": Band(0.6, 6.0, 0.60, 3.0),
    "south_asian": Band(0.3, 6.0, 0.98, 2.5),
    "east_asian": Band(0.3, 4.0, 0.90, 3.0),
    "none": Band(0.3, 4.0, 0.90, 3.0),
}
_NAMES = [*SCRIPTS, "none"]


class Pieces:
    """Token ids by pre-token, one after the other in one array."""

    def __init__(self, model: str, room: int = ROOM):
        import sentencepiece

        self.model, self.room = sentencepiece.SentencePieceProcessor(model_file=model), room
        size = self.model.vocab_size()
        if not separable([self.model.id_to_piece(i) for i in range(size)]):
            raise ValueError("a piece of this vocabulary joins words: texts can't be measured by word")
        self.is_byte = np.array([self.model.is_byte(i) for i in range(size)])
        self.start_over()

    def start_over(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, words: list[str]) -> np.ndarray:
        """The place of every word; those not met before are encoded together."""
        if len(self.place) > self.room:
            self.start_over()
        fresh = [w for w in words if w not in self.place]
        if fresh:
            # A space with nothing behind it is one token.
            found = [ids or [self.space] for ids in self.model.encode(fresh, num_threads=1)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            starts = len(self.ids) + np.cumsum(sizes) - sizes
            self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh)), strict=True))
            self.ids = np.concatenate([self.ids, *(np.array(x, np.int32) for x in found)])
            self.starts, self.sizes = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes])
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    @property
    def space(self) -> int:
        return self.model.piece_to_id(SPACE)


def pre_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All pre-tokens, each without its first space, and how many each text has."""
    odd = pc.or_(pc.or_(pc.starts_with(texts, " "), pc.match_substring(texts, "  ")), pc.match_substring(texts, SPACE))
    split = pc.split_pattern(texts, " ")
    if not pc.any(odd).as_py():
        return split.flatten(), np.diff(split.offsets.to_numpy())
    rows = split.to_pylist()
    for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
        marked = SPACE + texts[i].as_py().replace(" ", SPACE)
        rows[i] = [m[0][1:].replace(SPACE, " ") for m in SEGMENT.finditer(marked)]
    return pa.array([w for r in rows for w in r], pa.large_string()), np.fromiter(map(len, rows), np.int64, len(rows))


def token_measures(texts: pa.Array, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, byte tokens and entropy (bits a token) of each text; none may be null."""
    n = len(texts)
    flat, counts = pre_tokens(texts)
    empty = (pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0)
    coded = flat.dictionary_encode()
    place = pieces.find(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
    doc = np.repeat(np.arange(n), counts)
    live = ~empty[doc]
    doc, place = doc[live], place[live]
    sizes = pieces.sizes[place]
    ends = np.cumsum(sizes)
    ids = pieces.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(pieces.starts[place] - ends + sizes, sizes)]
    of = np.repeat(doc, sizes)
    tokens = np.bincount(of, minlength=n)
    byte_tokens = np.bincount(of[pieces.is_byte[ids]], minlength=n)
    key = np.sort(of * np.int64(len(pieces.is_byte)) + ids)
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(edge, len(key)))
    spread = np.bincount(key[edge] // len(pieces.is_byte), times * np.log2(times), minlength=n)
    some = np.maximum(tokens, 1)
    return tokens, byte_tokens, np.maximum(np.log2(some) - spread / some, 0)


def text_measures(data: bytes, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts per text of a joined buffer; every text is followed by one blank that counts for nothing."""
    raw, n = np.frombuffer(data, np.uint8), len(offsets) - 1
    blank = np.zeros(256, bool)
    blank[[0x20, *range(0x09, 0x0E)]] = True

    def per_text(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[raw], dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    of = lambda chosen: np.isin(np.arange(256), list(chosen))
    starts_char = (np.arange(256) & 0xC0) != 0x80
    chars = per_text(starts_char) - 1  # the blank behind it
    out = {"chars": chars, "word_chars": per_text(starts_char & ~blank), "n_symbols": per_text(of(SYMBOLS))}
    seen = np.bincount(raw, minlength=256) > 0
    letters = [per_text(of(lead)) if seen[lead].any() else np.zeros(n, np.int64) for lead in SCRIPTS.values()]
    most = np.stack(letters)
    out["script"] = np.where(most.max(axis=0) > 0, most.argmax(axis=0), len(SCRIPTS))

    gap = np.concatenate([[True], blank[raw]])
    begins = np.flatnonzero(gap[:-1] & ~gap[1:])
    doc = np.searchsorted(offsets, begins, side="right") - 1
    out["n_words"] = np.bincount(doc, minlength=n)
    out["n_repeat_words"] = np.zeros(n, np.int64)
    runs = run_hashes(word_hashes(data), WINDOW)
    inside = np.flatnonzero(doc[: len(runs)] == doc[WINDOW - 1 :][: len(runs)]) if len(runs) else np.zeros(0, np.int64)
    if len(inside):
        own = mix(runs[inside] + doc[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(own, kind="stable")
        equal = (own[order][1:] == own[order][:-1]) & (doc[inside][order][1:] == doc[inside][order][:-1])
        twice = np.zeros(len(inside), bool)
        twice[order[1:]] |= equal
        twice[order[:-1]] |= equal
        cover = np.zeros(len(doc) + WINDOW + 1, np.int64)
        np.add.at(cover, inside[twice], 1)
        np.add.at(cover, inside[twice] + WINDOW, -1)
        out["n_repeat_words"] = np.bincount(doc[np.cumsum(cover)[: len(doc)] > 0], minlength=n)
    return out


def repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def verdicts(bands: dict[str, Band], script: np.ndarray, chars, tokens, byte_tokens, entropy) -> list[str]:
    """Which measure lies outside the band of the text's script, or an empty string."""
    own = [bands.get(name, bands["none"]) for name in _NAMES]
    low, high, most, least, enough = (np.array([getattr(b, f) for b in own])[script] for f in ("low", "high", "bytes", "entropy", "tokens"))
    some = np.maximum(tokens, 1)
    rate, share = chars / some, byte_tokens / some
    asked = least * np.minimum(1, np.log2(some) / np.log2(enough))
    tests = [(rate < low, "few characters a token"), (rate > high, "many characters a token"), (share > most, "bytes"), (entropy < asked, "entropy")]
    return ["" if not t else r for t, r in zip(tokens, np.select([t for t, _ in tests], [r for _, r in tests], "").tolist(), strict=True)]


FIELDS = [
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("n_tokens", pa.int64()),
    ("chars_per_token", pa.float64()), ("byte_share", pa.float64()), ("entropy", pa.float64()), ("script", pa.string()),
    ("outside", pa.string()),
]
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "n_tokens long, chars_per_token double, byte_share double, entropy double, script string, outside string"
)


def measured(texts: pa.Array, pieces: Pieces, bands: dict[str, Band]) -> list[pa.Array]:
    """The report's columns for texts without nulls."""
    data = texts.cast(pa.large_binary()).to_pylist()
    offsets = np.concatenate([[0], np.cumsum([len(x) + 1 for x in data], dtype=np.int64)])
    m = text_measures(b" ".join([*data, b""]), offsets)
    tokens, byte_tokens, entropy = token_measures(texts, pieces)
    failed = (m["n_words"] < FEWEST) | (100 * m["n_repeat_words"] > REPEATED * m["n_words"])
    outside = verdicts(bands, m["script"], m["chars"], tokens, byte_tokens, entropy)
    some = np.maximum(tokens, 1)
    columns = {
        **m, "n_dup_lines": [repeated_lines(x) for x in data], "base_failed": failed, "kept": ~failed & (np.array(outside, object) == ""),
        "n_tokens": tokens, "chars_per_token": m["chars"] / some, "byte_share": byte_tokens / some, "entropy": entropy,
        "script": [_NAMES[i] for i in m["script"]], "outside": outside,
    }
    return [pa.array(columns[name], kind) for name, kind in FIELDS]


def quality_report(
    df: DataFrame,
    model: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    bands: dict[str, Band] | None = None,
) -> DataFrame:
    """One row per input row: counts of whole texts, measures of the vocabulary, ``base_failed`` and ``kept``.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols``, ``n_dup_lines`` (lines with a word that
    equal an earlier line), ``n_repeat_words`` (words in windows of 8 words that occur twice). The base
    fails below 20 words or with more than 30 % of them in such windows. ``kept`` further asks that
    ``chars_per_token``, ``byte_share`` and ``entropy`` lie in the band of the text's ``script``; ``outside``
    names the first that doesn't. ``bands`` replaces the bands of scripts; "none" is for texts without letters.

    ``model`` is a sentencepiece file with byte tokens. Nothing is shuffled. Null and empty texts have
    counts of 0 and fail; a null id is carried along; repeated rows are judged each; other columns are
    ignored; an empty table gives no rows.
    """
    docs = identified(df, id_col, text_col)
    kind, version = docs.schema["doc_id"].dataType.simpleString(), uuid.uuid4().hex
    asked = {**BANDS, **(bands or {})}

    def run(batches_):
        pieces = worker_state("pieces", lambda: Pieces(model), version)
        for batch in batches_:
            texts = batch.column("text").cast(pa.large_string())
            for a, b in slices(texts, SLICE):
                part = pc.fill_null(texts.slice(a, b - a), "")
                columns = [batch.column("doc_id").slice(a, b - a), *measured(part, pieces, asked)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(name for name, _ in FIELDS)])

    return docs.mapInArrow(run, f"doc_id {kind}, {SCHEMA}")
