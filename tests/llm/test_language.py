import math
import random
import zlib

import numpy as np
import pytest

from corpusloom.llm import language

SYLLABLES = {"aa": "ka to mi ra su", "bb": "schen ver ung keit ein", "cc": "eaux tion ou que ment", "dd": "ció dad os ar ente",
             "ee": "szcz owy dzi nie prz", "ff": "ään yö kka lla ssa"}


def text(lang, seed, n=60):
    pick = random.Random(f"{lang}{seed}")
    parts = SYLLABLES[lang].split()
    return " ".join("".join(pick.choices(parts, k=pick.randint(1, 3))) for _ in range(n))


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def corpus(langs, n=40):
    return [(1000 * k + i, text(lang, i), lang, "s") for k, lang in enumerate(langs) for i in range(n)]


@pytest.mark.parametrize("langs", [["aa"], ["aa", "bb"], ["aa", "bb", "cc", "dd"], [*SYLLABLES]])
def test_held_out_accuracy(docs_of, langs):
    rows = corpus(langs)
    lang = {i: x for i, _, x, _ in rows}
    got = language.identify_languages(docs_of(rows)).collect()
    assert all(r["held_out"] == held_out(r["doc_id"]) for r in got)
    assert all(0 <= r["score"] <= 1 for r in got)
    out = [r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"]]
    assert len(out) > 3 and sum(out) >= 0.95 * len(out)


def test_labels_of_held_out_rows_do_not_matter(docs_of):
    rows = corpus(["aa", "bb"])
    lied = [(i, t, "bb" if held_out(i) else x, "other") for i, t, x, _ in rows]
    first = language.identify_languages(docs_of(rows)).select("doc_id", "lang_pred", "score").collect()
    again = language.identify_languages(docs_of(lied)).select("doc_id", "lang_pred", "score").collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))


def test_awkward_rows(docs_of, awkward):
    rows = [*awkward, (20, "12 %% 34 --", "en", "a"), (21, "中文", None, "a")]
    got = language.identify_languages(docs_of(rows)).collect()
    assert len(got) == len(rows)
    und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert und == {4, 5, 6, 20, None}
    assert all(r["score"] == 0 for r in got if r["lang_pred"] == "und")


def test_nothing_to_learn(docs_of):
    got = language.identify_languages(docs_of([(1, "some words", None, None)])).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)]
    assert language.identify_languages(docs_of([])).count() == 0


def test_mixtures_are_ambiguous_and_go(docs_of):
    rows = corpus(["aa", "bb"])
    half = text("aa", 500, 300) + " " + text("bb", 500, 160)
    df = docs_of([*rows, (9000, text("aa", 600, 200), None, None), (9001, "...", None, None), (9002, None, None, None)])
    kept = language.with_language(df)
    assert kept.columns == df.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == {i for i, *_ in rows} | {9000}
    assert half


def test_codewords_differ_in_many_bits():
    for n in (2, 3, 4, 5, 9, 40):
        code = language.codewords(n)
        differing = (code.shape[1] - code @ code.T) / 2 + 99 * np.eye(n)
        assert differing.min() >= max(1, code.shape[1] // 4)


def test_pieces_do_not_change_shares(monkeypatch):
    data = text("cc", 1, 900).encode()
    whole = language.grams(data)
    assert abs(whole.sum() - 1) < 1e-9
    monkeypatch.setattr(language, "PIECE", 1000)
    assert np.abs(language.grams(data) - whole).max() < 2e-3


@pytest.mark.parametrize("langs", [["aa", "bb"], ["aa", "bb", "cc"], [*SYLLABLES]])
def test_decoding_against_brute_force(langs):
    """Every codeword's loss, summed bit by bit in plain Python from the margins."""
    profiles = np.array([sum(language.grams(text(x, i).encode()) for i in range(20)) for x in langs])
    model = language.learn(langs, profiles)
    model.trust[:] = np.random.default_rng(1).uniform(0.2, 1, model.trust.shape)
    for i, x in enumerate([*langs] * 3):
        data = (text(x, 900 + i, 30) + " " + text(langs[i % len(langs)], i, 25)).encode()
        odds = [
            sum(language.GAIN * s * w for s, w in zip(language.grams(data), model.weights[:, b], strict=True))
            for b in range(model.code.shape[1])
        ]
        loss = []
        for word, trust in zip(model.code, model.trust, strict=True):
            terms = [t * math.exp(min(max(-o * sign, -20), 20)) for t, o, sign in zip(trust, odds, word, strict=True)]
            loss.append(sum(terms) / sum(trust))
        got, score, near = model.predict(data)
        ranked = sorted(range(len(langs)), key=loss.__getitem__)
        assert got == langs[ranked[0]]
        assert near == (loss[ranked[1]] < (1 + language.NEAR) * loss[ranked[0]])
        assert score >= 1 / len(langs) - 1e-9


def test_only_the_commonest_labels_are_learned(docs_of, monkeypatch):
    monkeypatch.setattr(language, "MAX_LANGUAGES", 2)
    rows = [*corpus(["aa", "bb"]), *corpus(["cc"], 5)]
    assert {r["lang_pred"] for r in language.identify_languages(docs_of(rows)).collect()} == {"aa", "bb"}
