import hashlib
import random

from support import prose, words_of

from corpusloom.llm import substrings


def brute(rows, window):
    """(id, words, removed, kept) by comparing every window with those of smaller ids."""
    first = {}
    for i, t in rows:
        w = words_of(t)
        for j in range(len(w) - window + 1):
            key = tuple(w[j : j + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w, gone = words_of(t), set()
        for j in range(len(w) - window + 1):
            if i is not None and first[tuple(w[j : j + window])] < i:
                gone.update(range(j, j + window))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(map(repr, out))


def spliced(seed):
    """Documents that share passages of all lengths, some with a word changed or repeated in place."""
    pick = random.Random(seed)
    pool = [prose(seed * 100 + i, pick.randint(20, 160)).split() for i in range(6)]
    rows = []
    for i in pick.sample(range(1000), 40):
        w = []
        for _ in range(pick.randint(1, 4)):
            p = pick.choice(pool)
            a = pick.randrange(len(p))
            w += p[a : a + pick.randint(1, len(p))] + prose(pick.random(), pick.randint(0, 30)).split()
        if pick.random() < 0.3 and w:
            w[pick.randrange(len(w))] = "changed"
        if pick.random() < 0.2:
            w += w
        rows.append((i, pick.choice([" ", "\n", " \t "]).join(w)))
    return rows + [(rows[0][0], rows[0][1]), (2000, rows[1][1]), (2001, "same " * 300), (2002, "same " * 200)]


def test_against_all_windows(docs_of, awkward):
    for seed in (1, 2):
        rows = spliced(seed) + [r[:2] for r in awkward]
        got = substrings.repeat_digests(docs_of(rows)).collect()
        assert sorted(repr(tuple(r)) for r in got) == brute(rows, 50)


def test_short_windows_and_parts(docs_of, monkeypatch):
    monkeypatch.setattr(substrings, "PART", 16)
    rows = spliced(3)
    got = substrings.repeat_digests(docs_of(rows), window=12, gram=4).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(rows, 12)


def test_hot_keys_are_split_off_and_nothing_changes(docs_of, monkeypatch):
    monkeypatch.setattr(substrings, "HOT_KEYS", 6)
    passage = prose(9, 90).split()
    mid = [(3000 + i, " ".join(prose(i, 12).split() + passage[i % 7 : 60 + i % 5])) for i in range(60)]
    rows = spliced(4) + mid + [(4000, mid[0][1])] * 20 + [(4000, mid[1][1])]
    got = substrings.repeat_digests(docs_of(rows)).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(rows, 50)


def test_keys_to_broadcast_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT_KEYS", 5)
    keys = [0] * 300 + [1] * 200 + list(range(2, 120)) * 2
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, doc_id long")
    found = substrings.counted(rows, "k")
    joined = substrings.met(rows, found, "k")
    assert sorted(map(tuple, joined.collect())) == sorted((k, i, keys.index(k)) for i, k in enumerate(keys))
    limit = found.agg({"__n": "sum"}).first()[0] // 5
    assert {r["k"] for r in found.where(f"__n > {limit}").collect()} == {0, 1}


def test_kept_text(docs_of):
    passage = prose(7, 55)
    rows = [(1, passage), (2, f"before {passage}\nafter")]
    got = {r["doc_id"]: r["kept"] for r in substrings.remove_repeats(docs_of(rows)).collect()}
    assert got == {1: passage, 2: "before after"}


def test_empty_table(docs_of):
    assert substrings.repeat_digests(docs_of([])).count() == 0
