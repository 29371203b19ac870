"""Operator 3, token counts: a broadcast table of frequent pre-tokens and worker caches."""

from __future__ import annotations

import re
import uuid
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shipping import ship
from .shared import identified, worker_state

ship(__name__)

SPACE = "▁"
#: A pre-token: a run of spaces and what follows up to the next space.
SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def separable(pieces: list[str]) -> bool:
    """Whether no piece goes on with a space after something else, so that pre-tokens can't merge."""
    return not any(SPACE in p.lstrip(SPACE) for p in pieces)


class Lengths(dict):
    """Tokens by pre-token, without its first space: frequent ones and, up to a bound, those met before."""

    def __init__(self, model: str, frequent: dict[str, int], room: int):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        if not separable([self.model.id_to_piece(i) for i in range(self.model.vocab_size())]):
            raise ValueError("a piece of this vocabulary joins words: texts can't be counted by word")
        self.frequent, self.room = frequent, room
        self.start()

    def start(self) -> None:
        self.clear()
        self.update(self.frequent)
        self[""] = 1  # a space with nothing behind it
        self.full = len(self) + self.room

    def __missing__(self, word: str) -> int:
        if len(self) >= self.full:
            self.start()
        n = self[word] = len(self.model.encode(word))
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if text[0] != " " and "  " not in text and SPACE not in text:
            return sum(map(self.__getitem__, text.split(" ")))
        marked = SPACE + text.replace(" ", SPACE)
        return sum(self[m[0][1:].replace(SPACE, " ")] for m in SEGMENT.finditer(marked))


def frequent_words(docs: DataFrame, model: str, sample_rows: int, entries: int) -> dict[str, int]:
    """Tokens of the commonest pre-tokens in a sample of about ``sample_rows`` documents.

    Every row is drawn on its own, whatever its id and text. The sample only decides what the workers
    needn't encode; results are the same with any table. Counting stays in the tasks: each gives
    its own ``entries`` commonest, and no pre-token is shuffled.
    """
    total = docs.count()
    if not total:
        return {}
    chosen = docs.sample(min(1.0, sample_rows / total), seed=3)

    def commonest(batches_):
        seen, lengths = Counter(), Lengths(model, {}, 1 << 17)
        for batch in batches_:
            for text in batch.column("text").to_pylist():
                if text:
                    seen.update(text.split(" "))
        top = seen.most_common(entries)
        yield pa.RecordBatch.from_pydict(
            {"word": [w for w, _ in top], "seen": [n for _, n in top], "tokens": [lengths[w] for w, _ in top]},
            pa.schema([("word", pa.string()), ("seen", pa.int64()), ("tokens", pa.int32())]),
        )

    found = chosen.select("text").repartition(-(-sample_rows // 500)).mapInArrow(commonest, "word string, seen long, tokens int")
    seen, tokens = Counter(), {}
    for r in found.collect():
        seen[r["word"]] += r["seen"]
        tokens[r["word"]] = r["tokens"]
    return {w: tokens[w] for w, _ in seen.most_common(entries)}


def count_tokens(
    df: DataFrame,
    model: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 4096,
    sample_rows: int = 2000,
    entries: int = 1 << 15,
    room: int = 1 << 18,
) -> DataFrame:
    """Tokens of every whole text under a sentencepiece BPE model, without begin or end tokens.

    One row per input row: ``doc_id, n_bytes, n_tokens, over_limit``. The text is cut into
    pre-tokens where no merge of the model can reach across (checked on the vocabulary), and
    their lengths added up. Lengths of at most ``entries`` frequent pre-tokens are broadcast;
    any other is encoded once per worker and remembered while at most ``room`` are. Nothing is
    shuffled but the sample.

    Null and empty texts have 0 bytes and 0 tokens; a null id is carried along; repeated rows
    are counted each; an empty table gives no rows; other columns are ignored.
    """
    docs = identified(df, id_col, text_col)
    frequent = df.sparkSession.sparkContext.broadcast(frequent_words(docs, model, sample_rows, entries))
    version = uuid.uuid4().hex
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches_):
        lengths = worker_state("lengths", lambda: Lengths(model, frequent.value, room), version)
        for batch in batches_:
            counts = [lengths.count(t) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counted = sized.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
