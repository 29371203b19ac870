import random

import pytest

from corpusloom.operators import snapshots
from corpusloom.operators.skew import spread_join
from corpusloom.operators.snapshots import (
    SubpathNotFound,
    compare_snapshots,
    directory_digests,
    follow_references,
    resolve_references,
    select_subpath,
)


def test_compare(corpus_of):
    before = corpus_of({"a": "1", "b": "2", "c": "3", "e": ""})
    after = corpus_of({"a": "1", "b": "x", "d": "4", "e": ""})
    got = {r.path: r.change for r in compare_snapshots(before, after).collect()}
    assert got == {"a": "same", "b": "changed", "c": "removed", "d": "added", "e": "same"}


def test_compare_reads_texts_once_and_shuffles_none(corpus_of):
    plan = compare_snapshots(corpus_of({"a": "1"}), corpus_of({"a": "2"}))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in text


def test_equal_directories_are_not_joined(corpus_of, monkeypatch):
    """Files that change, move and vanish, against sets; equal directories stand aside whatever lies above them."""
    pick = random.Random(7)
    old = {f"{pick.choice('abc')}/{pick.choice('de')}/{i}": str(i % 5) for i in range(120)} | {"top": "x", "/r/s": "1"}
    new = {k: v for k, v in old.items() if k != "a/d/gone"} | {"b/e/new": "1", "c/new/x": "", "top": "y"}
    for k in list(new):
        if k.startswith("a/d/"):
            new[k.replace("a/d/", "a/f/")] = new.pop(k)
    moved = next(k for k in new if k.startswith("b/e/"))
    new[moved] += "!"
    got = {r.path: r.change for r in compare_snapshots(corpus_of(old), corpus_of(new)).collect()}
    assert got == {
        k: "removed" if k not in new else "added" if k not in old else "same" if old[k] == new[k] else "changed"
        for k in {*old, *new}
    }
    digests = lambda files: snapshots._digests(corpus_of(files))
    equal = {r[0] for r in snapshots._equal_directories(digests(old), digests(new)).collect()}
    assert {"a/e", "b/d", "c/d", "c/e", "/r"} <= equal and not {"", "a", "a/d", "b", "b/e", "c"} & equal


def test_digests_of_directories(corpus_of):
    files = {"a/b/1": "x", "a/b/2": "y", "a/3": "z", "4": ""}
    got = {r["dir"]: (r["files"], r["digest"]) for r in directory_digests(snapshots._digests(corpus_of(files))).collect()}
    assert {d: n for d, (n, _) in got.items()} == {"": 4, "a": 3, "a/b": 2}
    other = {r["dir"]: r["digest"] for r in directory_digests(snapshots._digests(corpus_of(dict(reversed(files.items())) | {"4": "!"}))).collect()}
    assert other["a"] == got["a"][1] and other["a/b"] == got["a/b"][1] and other[""] != got[""][1]


def test_subpath(corpus_of):
    files = corpus_of({"src/a": "", "src/lib/b": "", "src-x/c": "", "src": "", "d": ""})
    assert {r.path for r in select_subpath(files, "src/").collect()} == {"src/a", "src/lib/b", "src"}
    assert {r.path for r in select_subpath(files, "src/lib").collect()} == {"src/lib/b"}
    assert select_subpath(files, "").count() == 5
    with pytest.raises(SubpathNotFound, match="Subpath 'nope' not found"):
        select_subpath(files, "nope")
    assert select_subpath(files, "nope", check=False).count() == 0


def test_references(spark):
    refs = spark.createDataFrame(
        [
            ("r", "c0ffee", "c0ffee"), ("r", "refs/heads/main", "h1"), ("r", "refs/tags/main", "t1"),
            ("r", "refs/tags/v1", "t2"), ("r", "refs/remotes/origin/dev", "o1"),
            ("r", "refs/heads/refs/tags/v1", "odd"), ("q", "refs/heads/main", "h2"),
        ],
        "repo string, name string, commit string",
    )
    defaults = spark.createDataFrame([("r", "d1"), ("q", "d2")], "repo string, commit string")
    asked = [
        (1, "r", "c0ffee", "c0ffee", True), (2, "r", "main", "h1", True), (3, "r", "v1", "t2", True),
        (4, "r", "dev", "o1", True), (5, "r", "refs/tags/main", "t1", True),
        (6, "r", "refs/tags/v1", "t2", True), (7, "r", "nope", "d1", False), (8, "r", None, "d1", False),
        (9, "q", "main", "h2", True), (10, "q", "v1", "d2", False), (11, "z", "main", None, False),
        (12, "r", "refs/heads/nope", "d1", False),
    ]
    requests = spark.createDataFrame([a[:3] for a in asked], "id int, repo string, reference string")
    got = resolve_references(requests, refs, defaults).orderBy("id").collect()
    assert [tuple(r) for r in got] == asked


@pytest.mark.parametrize("how, expected", [("inner", 900), ("left", 1000), ("left_anti", 100), ("left_semi", 900)])
def test_spread_join_keeps_every_row_once(spark, how, expected):
    rows = spark.range(1000).selectExpr("id", "if(id < 900, 'hot', 'cold') k")
    lookup = spark.createDataFrame([("hot", 1)], "k string, v int")
    assert spread_join(rows, lookup, ["k"], how).count() == expected


def test_symbolic_references(spark):
    """Chains of any length, over kinds of names, circles, dangling targets and equal names in two repositories."""
    pick = random.Random(3)
    rows, expected = [], {}
    for repo in ("r", "q"):
        names = [f"refs/{pick.choice(['heads', 'tags'])}/n{i}" for i in range(60)]
        next_ = {n: pick.choice([None, None, "refs/heads/none", *names]) for n in names}
        if repo == "q":  # one long chain
            next_ = {n: m for n, m in zip(names, [*names[1:], None], strict=True)}
        for n in names:
            rows.append((repo, n, None if next_[n] else f"{repo}:{n}", next_[n]))
            at, seen = n, set()
            while at in next_ and next_[at] and at not in seen:
                seen.add(at)
                at = next_[at]
            if at in next_ and not next_[at]:
                expected[repo, n] = f"{repo}:{at}"
    refs = spark.createDataFrame(rows, "repo string, name string, commit string, target string")
    got = follow_references(refs).collect()
    assert {(r.repo, r.name): r.commit for r in got} == expected and len(got) == len(expected)
    requests = spark.createDataFrame([("q", "n0"), ("q", "refs/heads/none")], "repo string, reference string")
    defaults = spark.createDataFrame([("q", "d")], "repo string, commit string")
    answers = resolve_references(requests, refs, defaults).collect()
    assert {(r.reference, r.commit) for r in answers} == {("n0", expected["q", rows[60][1]]), ("refs/heads/none", "d")}
    assert follow_references(refs.limit(0)).count() == 0
