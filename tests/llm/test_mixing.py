import random
from collections import defaultdict

from support import prose, words_of

from corpusloom.llm import mixing


def targets(sizes, weights=(5, 2, 1), ratio=1.5, most=2):
    """By sharing the excess again until no source is above its cap."""
    names = sorted((n for n in sizes if n is not None)) + [None] * (None in sizes)
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    total, full = ratio * sum(sizes.values()), set()
    while True:
        open_ = [n for n in names if n not in full]
        left = total - sum(most * sizes[n] for n in full)
        share = {n: left * weight[n] / sum(weight[m] for m in open_) for n in open_}
        over = {n for n in open_ if share[n] > most * sizes[n] + 1e-9}
        if not over:
            return {n: most * sizes[n] for n in full} | share
        full |= over


def corpus(seed, n=900):
    pick = random.Random(seed)
    names = ["a"] * 6 + ["b", "B", "ä", "z", None, "solo"]
    return [(i, prose(i, pick.choice([0, 1, 5, 40, 40, 90, 300])), None, pick.choice(names)) for i in range(n)]


def check(rows, got):
    sizes, taken = defaultdict(int), defaultdict(int)
    source = {i: s for i, _, _, s in rows}
    for _, t, _, s in rows:
        sizes[s] += len(words_of(t))
    want = targets(sizes)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        expected = want[s] / sizes[s] if sizes[s] else 0
        assert expected - 1 < r["copies"] < expected + 1
        taken[s] += r["taken"]
    return {s: (taken[s], want[s]) for s in sizes}


def test_targets_and_taken_words(docs_of):
    rows = corpus(1)
    got = mixing.mix_sources(docs_of(rows)).collect()
    assert len(got) == len(rows)
    for taken, target in check(rows, got).values():
        assert abs(taken - target) <= 0.01 * target + 40


def test_equal_rows_are_no_group(docs_of, spark, monkeypatch):
    """A third of all rows are one document: each has a tie of its own, and words come near the target."""
    monkeypatch.setattr(mixing, "REPEATS", 64)
    counted = spark.createDataFrame([("a", 1, 77, 5, 1000), ("a", 2, 78, 5, 1), (None, None, 79, 0, 65)], "source string, doc_id long, own long, size long, n long")
    apart = mixing.told_apart(counted).collect()
    assert len(apart) == 1066 == len({r["tie"] for r in apart})
    assert {77, 78, 79} <= {r["tie"] for r in apart}
    rows = corpus(5, 400) + [(1000, prose(7, 30), None, "a")] * 200
    got = mixing.mix_sources(docs_of(rows)).collect()
    assert len(got) == len(rows)
    for taken, target in check(rows, got).values():
        assert abs(taken - target) <= 0.01 * target + 40
    copies = sum(r["copies"] for r in got if r["doc_id"] == 1000)
    assert mixing.mixed_documents(docs_of(rows)).where("doc_id = 1000").count() == copies


def test_reruns_agree_on_other_partitions(docs_of):
    df = docs_of(corpus(2, 400))
    first = mixing.mix_sources(df).select("doc_id", "copies").collect()
    again = mixing.mix_sources(df.repartition(11)).select("doc_id", "copies").collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))


def test_draws_keep_expectations(docs_of):
    """Documents of all lengths of a source are as likely to be taken once more."""
    pick = random.Random(5)
    rows = [(i, prose(i, pick.choice([10, 90])), None, pick.choice("ab")) for i in range(1500)]
    got = mixing.mix_sources(docs_of(rows)).collect()
    by = defaultdict(list)
    for r in got:
        by[(r["target"], r["size"])].append(r["copies"])
    for (target, _), copies in by.items():
        source = next(r["source_size"] for r in got if r["target"] == target)
        assert abs(sum(copies) / len(copies) - target / source) < 0.06


def test_awkward_rows(docs_of, awkward):
    got = mixing.mix_sources(docs_of(awkward)).collect()
    assert len(got) == len(awkward)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)


def test_documents_as_often_as_taken(docs_of):
    df = docs_of(corpus(3, 200))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(df).collect()}
    rows = mixing.mixed_documents(df)
    assert rows.columns == df.columns
    seen = defaultdict(int)
    for r in rows.collect():
        seen[r["doc_id"]] += 1
    assert seen == {i: c for i, c in copies.items() if c}


def test_many_sources_without_broadcast(docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "FEW_SOURCES", 0)
    rows = corpus(4, 150)
    check(rows, mixing.mix_sources(docs_of(rows)).collect())


def test_empty_tables(docs_of):
    assert mixing.mix_sources(docs_of([])).count() == 0
    assert mixing.mixed_documents(docs_of([])).count() == 0
    blank = mixing.mix_sources(docs_of([(1, "", None, "a"), (2, None, None, None)])).collect()
    assert [(r["taken"], r["target"]) for r in blank] == [(0, 0.0)] * 2


def test_no_python_in_the_plan(docs_of):
    plan = mixing.mix_sources(docs_of(corpus(6, 30)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
