import itertools
import math
import random

import pytest
from support import prose, words_of

from corpusloom.llm import decontaminate as D


def by_rule(rows, items, window=12, share=0.8):
    """(id, items) by laying every item at every place, whether or not a seed agrees there."""
    listed = {}
    for i, t in items:
        w = tuple(words_of((t or "").lower()))
        if i is not None and w:
            listed[w] = min(listed.get(w, i), i)
    out = []
    for d, t in rows:
        w, leaked = words_of((t or "").lower()), 0
        for b in listed:
            n = min(len(b), window)
            laid = ([0 <= s + j < len(w) and w[s + j] == x for j, x in enumerate(b)] for s in range(-len(b) + 1, len(w)))
            best = max((sum(same[j : j + n]) for same in laid for j in range(len(b) - n + 1)), default=0)
            leaked += best >= math.ceil(share * n - 1e-9)
        out.append((d, leaked))
    return sorted(map(repr, out))


@pytest.fixture(scope="module")
def items(spark):
    rows = [(i, prose(1000 + i, n, 3000)) for i, n in enumerate((3, 8, 10, 12, 13, 25, 40, 60))]
    rows += [(50, rows[5][1]), (None, rows[5][1]), (51, None), (52, "")]
    return rows, spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "1 AS words", "2 AS pos")


def planted(items, seed=3):
    pick, rows = random.Random(seed), []
    for i in range(60):
        body = prose(i, 80, 3000).split()
        item = words_of(pick.choice(items[1:8])[1])
        a = pick.randrange(len(item))
        part = item[a : a + pick.randint(4, 60)] if pick.random() < 0.5 else list(item)
        for _ in range(pick.choice([0, 0, 1, 2, 4])):
            part[pick.randrange(len(part))] = "changed"
        at = pick.choice([0, 40, len(body)])
        text = " ".join(body[:at] + part + body[at:])
        rows.append((i, text.upper() if pick.random() < 0.2 else text))
    return rows


def test_against_every_alignment(docs_of, items, awkward):
    rows = planted(items[0]) + [(r[0] and 100 + r[0], r[1]) for r in awkward if r[0] != 9]
    got = D.leak_report(docs_of(rows), items[1]).collect()
    expected = by_rule(rows, items[0])
    assert sorted(map(repr, ((r["doc_id"], r["n_items"]) for r in got))) == expected
    assert all(r["leaked"] == (r["n_items"] > 0) for r in got)
    assert all((r["matched"] or 0) >= 3 for r in got if r["leaked"])


def test_large_benchmarks_are_not_broadcast(docs_of, items, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_SEEDS", 0)
    rows = planted(items[0], 4)[:20]
    got = D.leak_report(docs_of(rows), items[1]).collect()
    assert sorted(map(repr, ((r["doc_id"], r["n_items"]) for r in got))) == by_rule(rows, items[0])


def test_rows_without_leaks(docs_of, items):
    rows = planted(items[0], 5)[:30] + [(None, items[0][6][1]), (99, None)]
    df = docs_of(rows)
    clean = D.without_leaks(df, items[1])
    leaked = {r["doc_id"] for r in D.leak_report(df, items[1]).where("leaked").collect()}
    assert clean.columns == df.columns
    assert sorted(map(str, (r["doc_id"] for r in clean.collect()))) == sorted(str(i) for i, _ in rows if i not in leaked)


def test_empty_tables(spark, docs_of, items):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.leak_report(docs_of([]), items[1]).count() == 0
    assert D.leak_report(docs_of([(1, items[0][6][1])]), none).where("leaked").count() == 0


def test_no_python_in_the_plan(docs_of, items):
    plan = D.leak_report(docs_of([(1, "a")]), items[1])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_masks_meet_every_pattern_of_substitutions():
    for n, share in [(n, 0.8) for n in range(1, 13)] + [(9, 0.5), (6, 0.1), (15, 0.75), (7, 1.0)]:
        masks = D.masks_of(n, share)
        for k in range(n - max(math.ceil(share * n - 1e-9), 1) + 1):
            for changed in map(set, itertools.combinations(range(n), k)):
                assert any(
                    all(bit == "0" or at + i not in changed for i, bit in enumerate(m))
                    for m in masks
                    for at in range(n - len(m) + 1)
                ), (n, share, changed)


def test_every_substitution_the_rule_accepts_is_found(spark, docs_of):
    asked, rows = [], []
    for n, k in ((8, 1), (9, 1), (10, 2), (11, 2), (12, 2)):
        item = [f"i{n}x{j}" for j in range(n)]
        asked.append((n, " ".join(item)))
        for changed in itertools.combinations(range(n), k):
            text = " ".join("other" if j in changed else w for j, w in enumerate(item))
            rows.append((len(rows), f"before {text} after", str(n), None))
    got = D.leak_report(docs_of(rows), spark.createDataFrame(asked, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["best_item"]) for r in got} == {(i, int(n)) for i, _, n, _ in rows}


@pytest.mark.parametrize("broadcast", [0, 1_000_000])
def test_against_the_rule_alone(docs_of, items, monkeypatch, broadcast):
    monkeypatch.setattr(D, "BROADCAST_SEEDS", broadcast)
    rows = planted(items[0], 3) + [(100 + i, t) for i, t in planted(items[0], 4)]
    got = D.leak_report(docs_of(rows), items[1]).collect()
    assert sorted(repr((r["doc_id"], r["n_items"])) for r in got) == by_rule(rows, items[0])


def test_items_of_few_words(spark, docs_of):
    asked = [(n, " ".join(f"i{n}x{j}" for j in range(n))) for n in range(1, 8)]
    rows = [(n, f"before {t} after", None, None) for n, t in asked] + [(10 + n, t.upper(), None, None) for n, t in asked]
    for n, t in asked:
        for j in range(n):
            words = t.split()
            words[j] = "other"
            rows.append((100 * n + j, " ".join(words), None, None))
    got = D.leak_report(docs_of(rows), spark.createDataFrame(asked, "item_id long, text string")).collect()
    assert sorted(repr((r["doc_id"], r["n_items"])) for r in got) == by_rule([r[:2] for r in rows], asked)
    assert all(r["leaked"] for r in got if r["doc_id"] < 100)
    assert {r["doc_id"] // 100 for r in got if r["leaked"]} == {0, 5, 6, 7}


def test_null_ids_are_searched(docs_of, items):
    clean = prose(77, 50, 90).replace("w", "v")
    df = docs_of([(None, items[0][6][1]), (None, clean), (1, items[0][6][1]), (2, clean), (None, None)])
    got = D.leak_report(df, items[1]).collect()
    assert sorted((str(r["doc_id"]), r["leaked"]) for r in got) == [
        ("1", True), ("2", False), ("None", False), ("None", False), ("None", True)
    ]
    left = [(r["doc_id"], r["text"]) for r in D.without_leaks(df, items[1]).collect()]
    assert sorted(map(repr, left)) == sorted(map(repr, [(None, clean), (2, clean), (None, None)]))
