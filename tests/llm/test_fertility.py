import math
import random
from collections import Counter

import pytest
from support import prose, words_of

from corpusloom.llm import fertility, shared
from corpusloom.llm.queries import vocabulary

MODEL = vocabulary("piece_bpe_32k.model")


def brute(text):
    """The base counts and the vocabulary's measures of one text, by the library and plain Python."""
    import sentencepiece

    t = text or ""
    w, n = words_of(t), len(words_of(t))
    windows = Counter(tuple(w[i : i + 8]) for i in range(n - 7))
    covered = {j for i in range(n - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if words_of(x)]
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids = model.encode(t)
    counts = Counter(ids)
    entropy = -sum(c / len(ids) * math.log2(c / len(ids)) for c in counts.values()) if ids else 0.0
    share = sum(model.is_byte(i) for i in ids) / max(len(ids), 1)
    failed = n < 20 or 100 * len(covered) > 30 * n
    base = (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed)
    return base, len(ids), round(len(t) / max(len(ids), 1), 9), round(share, 9), round(abs(entropy), 6)


def got_of(rows):
    names = [n for n, _ in fertility.FIELDS]
    out = []
    for r in rows:
        v = [r[n] for n in names]
        out.append((r["doc_id"], (tuple(v[:6]), v[7], round(v[8], 9), round(v[9], 9), round(abs(v[10]), 6))))
    return sorted(map(repr, out))


@pytest.fixture(scope="module")
def odd():
    pick, rows = random.Random(4), []
    loop = prose(3, 40)
    pieces = ["word", "ключ", "中文字", "λόγος", "naïve", "  ", " ", "\n", "\t", " ", "▁", "x" * 40, "#*$", "<b>|", "😀", "​", "A&B%"]
    for i in range(120):
        rows.append((100 + i, "".join(pick.choice(pieces) + pick.choice([" ", " ", "\n", ""]) for _ in range(pick.randint(0, 120)))))
    rows += [(300, f"{loop}\n{loop}\n{prose(5, 30)}"), (301, "\n".join(["same line here", " ", "same line here", "other", "same line here "])),
             (302, " ".join(["la"] * 500)), (303, " lead"), (304, "trail "), (305, "one\x1ctwo\x85three")]
    return rows


def test_against_brute_force(docs_of, awkward, odd):
    rows = [r[:2] for r in awkward] + odd
    df = docs_of(rows)
    expected = sorted(repr((i, brute(t))) for i, t in rows)
    assert got_of(fertility.quality_report(df, MODEL).collect()) == expected


def test_slices_do_not_matter(odd):
    import pyarrow as pa

    texts = pa.array([t for _, t in odd], pa.large_string())
    pieces = fertility.Pieces(MODEL, room=50)
    whole = [c.to_pylist() for c in fertility.measured(texts, pieces, fertility.BANDS)]
    one = [[c.to_pylist()[0] for c in fertility.measured(texts.slice(i, 1), pieces, fertility.BANDS)] for i in range(len(texts))]
    assert [list(x) for x in zip(*whole, strict=True)] == one
    ranges = list(shared.slices(pa.array(["a" * (1 << 22), None, "b", "c" * (1 << 23), ""], pa.large_string()), 1 << 22))
    assert [a for a, _ in ranges] == [0, *(b for _, b in ranges[:-1])] and ranges[-1][1] == 5


def test_bands(docs_of):
    """Clean prose of several scripts stays; what the vocabulary can't read, or reads as one token, goes."""
    english = "the people of the city went to see their new house and found that many things had changed since last year "
    russian = "люди города пошли посмотреть свой новый дом и увидели что многое изменилось с прошлого года потому что все долго работали и никто не хотел "
    chinese = "人们 去看 新的 房子 发现 很多 事情 从 去年 以来 已经 改变 了 今天 天气 很好 我们 一起 出去 走走 吧 "
    pick = random.Random(1)
    noise = " ".join("".join(pick.choice("ÃÂ¤¶¼€œ™ŸžšÐÑ") for _ in range(8)) for _ in range(60))
    digits = " ".join(str(pick.randrange(10**6)) for _ in range(80))
    bits = " ".join(f"a{pick.choice('ab')}" for _ in range(400))
    rows = [(1, english), (2, russian), (3, chinese), (4, noise), (5, digits), (6, bits), (7, english[:60])]
    got = {r["doc_id"]: r for r in fertility.quality_report(docs_of(rows), MODEL).collect()}
    assert [got[i]["kept"] for i in (1, 2, 3)] == [True] * 3
    assert [got[i]["script"] for i in (1, 2, 3, 5)] == ["latin", "cyrillic", "east_asian", "none"]
    assert not got[4]["kept"] and not got[4]["base_failed"] and got[4]["outside"]
    assert not got[6]["kept"] and got[6]["outside"]
    assert not got[7]["kept"] and got[7]["base_failed"]
    strict = fertility.quality_report(docs_of(rows[:1]), MODEL, bands={"latin": fertility.Band(50, 60, 0, 0)}).collect()
    assert [(r["kept"], r["outside"]) for r in strict] == [(False, "few characters a token")]


def test_empty_table(docs_of):
    assert fertility.quality_report(docs_of([]), MODEL).count() == 0
