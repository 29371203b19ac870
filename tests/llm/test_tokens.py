import random
import zlib

import numpy as np
import pytest

from corpusloom.llm import tokenfiles, tokens

tokenizers = pytest.importorskip("public_tokenizers")
PIECES = tokenizers.path("piece_bpe_32k.model")
WORDS = tokenizers.path("word_bpe_49k.json")


def odd_texts():
    pick = random.Random(8)
    bits = [" ", "  ", "\n", "\t", "\x0b", "▁", "a", "the", "é", "é", "日本", "<s>", "<|endoftext|>", "<|startoftext|>", " "]
    bits += ["'s", "don't", "12", "\U0001f600", "Σ", "ẞ", "\x1c", " ", "%%", "\x00", "İ"]
    bits += [".", ",", "!?", "The", "JAN", "É", "J\u030c", "\u0301", "<|ENDOFTEXT|>", "ª", "\u0250", "\u00a0", "'S", ")"]
    return ["".join(pick.choices(bits, k=pick.randint(0, 25))) for _ in range(600)]


def test_counts_equal_the_library(docs_of, awkward):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = [*enumerate(odd_texts(), 100), *(r[:2] for r in awkward)]
    got = tokens.count_tokens(docs_of(rows), PIECES, room=50, entries=20).collect()
    want = [(i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_the_sample_is_bounded_whatever_the_ids(spark):
    """Null ids and equal rows are drawn one by one, so a third of all rows can't be in the sample together."""
    docs = spark.range(40_000).selectExpr("if(id % 3 = 0, id, null) AS doc_id", "'the same words' AS text")
    drawn = docs.sample(min(1.0, 500 / docs.count()), seed=3).count()
    assert 300 < drawn < 800
    table = tokens.frequent_words(docs, PIECES, 500, 10)
    assert set(table) == {"the", "same", "words"}


def test_vocabulary_that_joins_words_is_refused():
    assert tokens.separable(["▁a", "▁▁", "b"])
    assert not tokens.separable(["a▁b"])


def test_files_equal_the_library(docs_of, awkward):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    rows = [*enumerate(odd_texts(), 100), *(r[:2] for r in awkward)]
    got = tokenfiles.token_output(docs_of(rows), WORDS, end_id=2, room=50).collect()
    encoded = {}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        encoded.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    found = {}
    for r in got:
        found.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in encoded.items()}
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ordered = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ordered == sorted(ordered, key=lambda i: (i is not None, i or 0))


def test_files_hold_what_was_encoded(spark, docs_of, tmp_path):
    path = tokenfiles.write_token_files(docs_of([(5, "the cat"), (3, None), (4, "a")]), WORDS, 2, str(tmp_path / "ids"))
    rows = tokenfiles.read_token_files(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [3, 4, 5]
    assert rows[0]["ids"] == [2] and rows[2]["ids"][-1] == 2 and len(rows[2]["ids"]) == 3
    some = tokenfiles.read_documents(spark, path, [4, 5, 77])
    assert sorted(r["doc_id"] for r in some.collect()) == [4, 5]
    assert "PushedFilters: [In(doc_id, [4,5,77])]" in some._jdf.queryExecution().executedPlan().toString()


def test_slices_do_not_change_ids(docs_of, awkward, monkeypatch):
    rows = [*enumerate(odd_texts()[:200], 100), *(r[:2] for r in awkward)]
    whole = tokenfiles.token_output(docs_of(rows), WORDS, 2).collect()
    monkeypatch.setattr(tokenfiles, "SLICE", 40)
    small = tokenfiles.token_output(docs_of(rows), WORDS, 2).collect()
    key = lambda r: (r["n_tokens"], r["ids_crc32"], str(r["doc_id"]))
    assert sorted(map(key, whole)) == sorted(map(key, small))


def test_empty_tables(docs_of):
    assert tokens.count_tokens(docs_of([]), PIECES).count() == 0
    assert tokenfiles.token_output(docs_of([]), WORDS, 2).count() == 0
