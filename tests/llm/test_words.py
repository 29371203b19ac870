import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import words as W


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=40), max_size=12), st.integers(1, 9))
def test_hashes_do_not_depend_on_pieces(parts, piece):
    data = b" ".join(parts)
    whole = W.word_hashes(data)
    assert len(whole) == len(data.split())
    kept, W.PIECE = W.PIECE, piece
    try:
        assert (W.word_hashes(data) == whole).all()
    finally:
        W.PIECE = kept


def test_equal_words_and_only_they_are_equal():
    pick = random.Random(5)
    listed = [bytes(pick.choices(b"abc", k=pick.randint(1, 9))) for _ in range(3000)]
    hashes = W.word_hashes(b"\n".join(listed))
    assert len({*listed}) == len({*hashes.tolist()}) == len({*zip(listed, hashes.tolist(), strict=True)})


def test_runs():
    words = np.arange(10, dtype=np.uint64)
    assert len(W.run_hashes(words, 3)) == 8
    assert len(W.run_hashes(words, 11)) == 0
    twice = np.concatenate([words, words])
    assert (W.run_hashes(twice, 3)[:8] == W.run_hashes(twice, 3)[10:]).all()
