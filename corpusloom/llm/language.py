"""Operator 2, language identification by error-correcting output codes.

Each language has a codeword of signs. For every bit a linear classifier over hashed byte n-grams
(log odds of the n-gram profiles of the languages on either side) predicts that bit of a text's
language. Decoding sums, for each codeword, the exponential loss of the bits, each weighed by how
well its classifier does on that language; the nearest codeword wins, and a text whose second
nearest is about as near is ambiguous.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shipping import ship
from .shared import identified, keep, sliced, texts_of, tidy, worker_state

ship(__name__)

BUCKETS, ORDERS = 1 << 14, (1, 2, 3, 4)
#: Training documents per language, expected number, chosen by a hash of the id.
ROWS_PER_LANGUAGE = 4000
#: Languages learned, at most: those with most labelled documents, ties by code point. A profile has 128 KB.
MAX_LANGUAGES = 1000
#: Added to every n-gram's share; the margin that a log odds of 1 per n-gram stands for; score steepness.
SMOOTH, GAIN, STEEP = 1e-6, 4.0, 12.0
#: Texts whose two nearest codewords differ less than this, relative to the nearer one, are ambiguous.
NEAR = 0.1
PIECE = 1 << 20
UNKNOWN = "und"
#: Name of the model among a worker's objects.
STATE = "language model"
LETTER = re.compile(rb"[A-Za-z]")
#: Lower case for A-Z, a blank for other ASCII that is no letter.
PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def has_letter(data: bytes) -> bool:
    return bool(LETTER.search(data)) or (not data.isascii() and any(c.isalpha() for c in data.decode()))


def grams(data: bytes) -> np.ndarray:
    """Share of every n-gram bucket in the text; the shares of each order add up to 1."""
    total = np.zeros(BUCKETS)
    for at in range(0, len(data), PIECE):
        part = np.frombuffer(data[max(0, at - max(ORDERS) + 1) : at + PIECE].translate(PLAIN), np.uint8).astype(np.uint32)
        key = np.zeros(len(part), np.uint32)
        for order in range(1, max(ORDERS) + 1):
            key = key[: len(part) - order + 1] * np.uint32(257) + part[order - 1 :]
            if order in ORDERS and len(key):
                slot = ((key + np.uint32(order)) * np.uint32(2654435761)) >> np.uint32(18)
                total += np.bincount(slot, minlength=BUCKETS)
    n = total.sum()
    return total / n if n else total


def codewords(n: int, seed: int = 2) -> np.ndarray:
    """n rows of signs: all ways to split up to five languages, else the best of 200 random codes."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        bits = [[1] + [1 if (c >> i) & 1 else -1 for i in range(n - 1)] for c in range(2 ** (n - 1) - 1)]
        return np.array(bits, float).T
    draw = np.random.default_rng(seed)
    length = 12 * int(np.ceil(np.log2(n)))
    codes = [np.where(draw.random((n, length)) < 0.5, -1.0, 1.0) for _ in range(200)]
    nearest = [((c @ c.T) - 2 * length * np.eye(n)).max() + 4 * (abs(c.sum(axis=0)) == n).sum() for c in codes]
    return codes[int(np.argmin(nearest))]


class Model:
    """Languages, their codewords, a weight per n-gram and bit, and how far each bit is trusted."""

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, trust: np.ndarray):
        self.languages, self.code, self.weights, self.trust = languages, code, weights, trust

    def arrays(self) -> tuple:
        """What a worker needs to build the model: no class of this package among it."""
        return self.languages, self.code, self.weights, self.trust

    def margins(self, data: bytes) -> np.ndarray:
        return GAIN * (grams(data) @ self.weights)

    def predict(self, data: bytes) -> tuple[str, float, bool]:
        """Language, score, ambiguous."""
        if not self.languages or not has_letter(data):
            return UNKNOWN, 0.0, False
        loss = (self.trust * np.exp(np.clip(-self.margins(data) * self.code, -20, 20))).sum(axis=1)
        loss /= self.trust.sum(axis=1)
        order = np.argsort(loss, kind="stable")
        share = np.exp(-STEEP * (loss - loss[order[0]]) / (loss[order[0]] + loss.mean() + 1e-12))
        close = len(order) > 1 and loss[order[1]] < (1 + NEAR) * loss[order[0]]
        return self.languages[order[0]], float(share[order[0]] / share.sum()), bool(close)


def learn(languages: list[str], profiles: np.ndarray) -> Model:
    """A bit's weights are the log odds of the profiles of the languages on its two sides."""
    code = codewords(len(languages))
    side = [profiles[code[:, b] == s].sum(axis=0) for b in range(code.shape[1]) for s in (1, -1)]
    share = [(x / max(x.sum(), 1e-12)) + SMOOTH for x in side]
    weights = np.stack([np.log(a / b) for a, b in zip(share[::2], share[1::2], strict=True)], axis=1)
    return Model(languages, code, weights, np.ones_like(code))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(rows: DataFrame, rows_per_language: int) -> DataFrame:
    """``lang, text``: about ``rows_per_language`` documents of each language learned, all if it has fewer."""
    commonest = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES)
    counts = {r["lang"]: r["count"] for r in commonest.collect()}
    if not counts:
        return rows.select("lang", "text")
    part = 1 << 30
    bound = {k: int(part * min(1.0, rows_per_language / n)) for k, n in counts.items()}
    bounds = F.create_map(*(x for k, n in bound.items() for x in (F.lit(k), F.lit(n))))
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(part)) <= F.try_element_at(bounds, F.col("lang"))).select("lang", "text")


def fit(rows: DataFrame, rows_per_language: int) -> Model:
    """Learn from ``doc_id, lang, text``. Tasks add up profiles; the driver gets one row per language."""
    sample = keep(training_rows(rows, rows_per_language))

    def profiles(batches_):
        sums: dict[str, np.ndarray] = {}
        for batch in sliced(batches_, "text"):
            for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch, "text"), strict=True):
                if has_letter(text):
                    sums[lang] = sums.get(lang, 0) + grams(text)
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "profile": [x.tobytes() for x in sums.values()]})

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x) for x in table["profile"].to_pylist())
        return pa.table({"lang": [table["lang"][0].as_py()], "profile": [total.tobytes()]})

    shape = "lang string, profile binary"
    found = sample.mapInArrow(tidy(profiles, STATE), shape).groupBy("lang").applyInArrow(added, shape).collect()
    found.sort(key=lambda r: r["lang"])
    model = learn([r["lang"] for r in found], np.array([np.frombuffer(r["profile"]) for r in found]).reshape(-1, BUCKETS))
    if len(found) < 2:
        return model
    place = {x: i for i, x in enumerate(model.languages)}

    def right(batches_):
        for batch in sliced(batches_, "text"):
            langs, texts = batch.column("lang").to_pylist(), texts_of(batch, "text")
            rows_ = [(x, (model.margins(t) * model.code[place[x]] > 0).tolist()) for x, t in zip(langs, texts, strict=True) if x in place and has_letter(t)]
            if rows_:
                yield pa.RecordBatch.from_pydict({"lang": [x for x, _ in rows_], "hit": [h for _, h in rows_]})

    hits = sample.mapInArrow(tidy(right, STATE), "lang string, hit array<boolean>").select("lang", F.posexplode("hit").alias("bit", "hit"))
    for r in hits.groupBy("lang", "bit").agg(F.avg(F.col("hit").cast("int")).alias("rate")).collect():
        model.trust[place[r["lang"]], r["bit"]] = max(r["rate"], 1e-3)
    return model


def learned(df: DataFrame, id_col: str, text_col: str, lang_col: str, rows_per_language: int):
    """A function that gives a worker's copy of the model fitted to ``df``."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    labelled = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    model = fit(labelled.where(~held_out(F.col("doc_id"))), rows_per_language)
    sent, version = df.sparkSession.sparkContext.broadcast(model.arrays()), uuid.uuid4().hex
    return lambda: worker_state(STATE, lambda: Model(*sent.value), version)


def identify_languages(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    rows_per_language: int = ROWS_PER_LANGUAGE,
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous``, one row per input row.

    The classifier learns from labelled documents whose crc32(id as text) mod 5 isn't 0; about
    ``rows_per_language`` of each language are taken by a hash of the id. Label, id and source are
    no inputs of a prediction; whole texts are read. The ``MAX_LANGUAGES`` commonest labels are learned,
    so the model is bounded whatever the labels are.

    Texts that are null or hold no letter are ``und`` with score 0, as is everything if nothing is
    labelled; rows with a null id aren't held out and not learned from; repeated rows count each;
    other columns are ignored; an empty table gives no rows.
    """
    docs = identified(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    model = learned(df, id_col, text_col, lang_col, rows_per_language)

    def run(batches_):
        own = model()
        for batch in sliced(batches_, "text"):
            columns = list(zip(*(own.predict(t) for t in texts_of(batch, "text")), strict=True))
            kinds = (pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
                ["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
            )

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        tidy(run, STATE), f"doc_id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean"
    )


def with_language(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    rows_per_language: int = ROWS_PER_LANGUAGE,
) -> DataFrame:
    """The rows of ``df`` whose language can be told, unchanged: not those that are ``und`` or ambiguous.

    Rows are judged where they are; nothing is shuffled but the training sample.
    """
    model = learned(df, id_col, text_col, lang_col, rows_per_language)

    def run(batches_):
        own = model()
        for batch in sliced(batches_, text_col):
            told = [own.predict(t) for t in texts_of(batch, text_col)]
            yield batch.filter(pa.array([lang != UNKNOWN and not near for lang, _, near in told], pa.bool_()))

    return df.mapInArrow(tidy(run, STATE), df.schema)
