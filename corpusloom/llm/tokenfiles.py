"""Operator 5, token-ID output: ORC files in document order, their index, and reading them back."""

from __future__ import annotations

import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shipping import ship
from .shared import identified, shared_folder, slices, tidy, worker_state

ship(__name__)

#: Words that are encoded as one text.
TOGETHER = 512
#: Bytes of text worked on at once; a longer text is worked on alone.
SLICE = 4 << 20
#: Marks that end words.
MARKS = ".,;:!?"


class Recent:
    """Values by word, for words met before, in ``known``.

    When ``room`` words are held, they become the older half; of that, what is met again moves back,
    so frequent words stay and memory is bounded by twice the room.
    """

    def __init__(self, room: int):
        self.room, self.known, self.older = room, {}, {}

    def turn(self) -> None:
        if len(self.known) > self.room:
            self.known, self.older = {}, self.known

    def unknown(self, words: set) -> list:
        """Those that aren't held, out of words that aren't in the newer half; what is in the older moves back."""
        if not self.older:
            return list(words)
        words = list(words)
        values = list(map(self.older.get, words))
        self.known.update((w, v) for w, v in zip(words, values, strict=True) if v is not None)
        return [w for w, v in zip(words, values, strict=True) if v is None]


class Words:
    """Ids as little-endian 32-bit bytes, by what words come down to."""

    def __init__(self, path: str, room: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer, self.cores = Tokenizer.from_file(path), Recent(room)

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, ``end`` behind each text's, and how many each has.

        Words become places in a list of distinct ones, and these come down to fewer cores and marks.
        Only cores and marks are looked up, and what isn't known of them is encoded together, once.
        The texts' ids are then taken from the words' by place.
        """
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        parts = [x.dictionary_encode() for x in parted(words.dictionary)]
        self.cores.turn()
        spelt = [x.dictionary.cast(pa.large_binary()).to_pylist() for x in parts]
        self.learn({w for part in spelt for w in part if w and w not in self.cores.known})
        ids = []
        for part, x in zip(spelt, parts, strict=True):
            found = pa.array([self.cores.known[w] if w else b"" for w in part], pa.large_binary())
            ids.append(found.take(x.indices))
        last = pa.array([np.array([end], "<i4").tobytes()], pa.large_binary())
        of_word = pa.concat_arrays([pc.binary_join_element_wise(*ids, pa.scalar(b"", pa.large_binary())), last])
        behind = split.offsets.to_numpy()[1:] - split.offsets.to_numpy()[0]
        place = np.insert(words.indices.to_numpy(), behind, len(of_word) - 1)
        taken = of_word.take(pa.array(place))
        _, bounds, data = taken.buffers()
        bounds = np.frombuffer(bounds, np.int64, len(taken) + 1)
        ends = bounds[behind + np.arange(1, len(texts) + 1)] // 4
        return np.frombuffer(data, "<i4", int(bounds[-1]) // 4), np.diff(ends, prepend=0)

    def learn(self, words: set) -> None:
        missing = self.cores.unknown(words)
        for at in range(0, len(missing), TOGETHER):
            self.cores.known.update(self.encoded(missing[at : at + TOGETHER]))

    def encoded(self, words: list[bytes]):
        """(word, ids) of some words, out of one text; a token belongs to the word in which it begins."""
        plain = [w.decode() for w in words]
        found = self.tokenizer.encode(" ".join(plain), add_special_tokens=False)
        begins = np.array([a for a, _ in found.offsets], np.int64)
        cuts = 4 * np.searchsorted(begins, np.cumsum([len(w) + 1 for w in plain]))
        raw, cuts = array("i", found.ids).tobytes(), [0, *cuts.tolist()]
        return zip(words, (raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)), strict=True)


#: Two-byte characters, by their bytes' bits, that are letters in lower case: those of the Latin blocks.
LATIN = np.array([0xAA <= c < 0x250 and chr(c).lower().isalpha() for c in range(0x800)])


def parted(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Each word as a core in lower case and the marks behind it, where these are tokens of their own.

    That is sure behind an ASCII letter, and behind others of the Latin blocks that are letters in
    lower case too. Only ASCII is lowered: other letters may compose differently in lower case.
    Special tokens are spelt in lower case, so ``<|`` is left.
    """
    core = pc.ascii_rtrim(words, MARKS)
    raw, whole = bytes_of(words)
    size, short = np.diff(whole), pc.binary_length(core).to_numpy(zero_copy_only=False)
    at = whole[:-1] + short  # the byte behind the core
    last, before = (np.where(short >= n, raw[np.maximum(at - n, 0)] if len(raw) else 0, 0).astype(np.int64) for n in (1, 2))
    letter = ((last | 32) >= 97) & ((last | 32) <= 122) & (last < 128)
    pair = (last >> 6 == 2) & (before >> 5 == 6)
    sure = (letter | (pair & LATIN[np.where(pair, (before & 31) << 6 | (last & 63), 0)])) & (short < size)
    core = pc.if_else(pa.array(sure), core, words)
    plain = pc.and_(pc.string_is_ascii(core), pc.invert(pc.match_substring(core, "<|")))
    behind = np.where(sure, size - short, 0)
    ends = np.cumsum(behind)
    marks = raw[np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - ends + behind, behind)]
    bounds = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64))
    return pc.if_else(plain, pc.ascii_lower(core), core), pa.LargeStringArray.from_buffers(len(words), bounds, pa.py_buffer(marks))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes behind a large string array and where each text begins among them."""
    _, bounds, data = texts.buffers()
    bounds = np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), bounds


def encode_documents(
    df: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", room: int = 1 << 19
) -> DataFrame:
    """``doc_id, n_tokens, token_offset, ids`` in ascending id order, one range of ids per partition.

    The tokenizer must drop white space and case and part words from marks (as those with a word end
    do), so that a text's ids are those of its words one after the other. ``token_offset`` counts the ids before the
    document in its own partition, hence in its file.
    """
    docs = identified(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches_):
        words, before = worker_state("words", lambda: Words(tokenizer, room), tokenizer), 0
        for batch in batches_:
            texts = batch.column("text").cast(pa.large_string())
            for a, b in slices(texts, SLICE):
                values, counts = words.encode(pc.fill_null(texts.slice(a, b - a), ""), end_id)
                ends = np.concatenate([[0], np.cumsum(counts)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array(counts),
                        pa.array(ends[:-1] + before),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32())),
                    ],
                    ["doc_id", "n_tokens", "token_offset", "ids"],
                )
                before += int(ends[-1])

    ranged = docs.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id")
    return ranged.mapInArrow(tidy(run, "words"), f"doc_id {kind}, n_tokens long, token_offset long, ids array<int>")


def write_token_files(df: DataFrame, tokenizer: str, end_id: int, path: str, stripe_bytes: int = 64 << 20, **columns) -> str:
    """Write every text's ids as ORC under ``path`` and return it.

    File order, then row order, is ascending document id. Ids are stored with integer run-length
    encoding in stripes of ``stripe_bytes``, which readers take in parallel; row indexes every
    10,000 rows and Bloom filters on ``doc_id`` let a reader of few documents skip the rest. The
    ORC writer and Spark's commit protocol make the write repeatable after lost tasks.

    Null and empty texts are just the end id; a null id comes first; repeated ids are all kept.
    """
    rows = encode_documents(df, tokenizer, end_id, **columns)
    options = {
        "compression": "zstd",
        "orc.stripe.size": str(stripe_bytes),
        "orc.create.index": "true",
        "orc.row.index.stride": "10000",
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": "0.01",
    }
    rows.write.mode("errorifexists").options(**options).orc(path)
    return path


def read_documents(spark: SparkSession, path: str, ids: list) -> DataFrame:
    """``doc_id, n_tokens, ids`` of some documents.

    The ids asked for are pushed to the ORC reader, which skips files, stripes and rows by their minimum,
    maximum and Bloom filter.
    """
    return spark.read.orc(path).where(F.col("doc_id").isin(ids)).select("doc_id", "n_tokens", "ids")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, n_tokens, start, ids`` of token files; ``start`` counts all ids before the document.

    The ids before a file are summed over the files, by their number in the name; that table has one
    short row per file, which a task wrote, and is broadcast. Those before a document in its file
    are in the file, so nothing but per-file sums is shuffled.
    """
    rows = spark.read.orc(path).withColumn("file", F.col("_metadata.file_name"))
    per_file = rows.groupBy("file").agg(F.max(F.col("token_offset") + F.col("n_tokens")).alias("held"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    begins = per_file.select("file", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(begins), "file").select(
        "doc_id", "n_tokens", (F.col("before") + F.col("token_offset")).alias("start"), "ids"
    )


def digests(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of what ``read_token_files`` gives."""
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches_):
        for batch in batches_:
            ids = batch.column("ids")
            bounds = ids.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(), "<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return tokens.select("doc_id", "start", "ids").mapInArrow(
        tidy(run), f"doc_id {kind}, start long, n_tokens long, ids_crc32 long"
    )


def token_output(df: DataFrame, tokenizer: str, end_id: int, **columns) -> DataFrame:
    """Write the ids to a new shared folder and give the digests read from it."""
    path = write_token_files(df, tokenizer, end_id, shared_folder(df.sparkSession), **columns)
    return digests(read_token_files(df.sparkSession, path))
