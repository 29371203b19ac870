import pytest

from corpusloom.operators import order as ordering
from corpusloom.operators.order import in_order
from corpusloom.operators.tree import directories, tree, tree_lines, tree_order, tree_text


def lines(files, by=None, order="path"):
    rows = tree_lines(files, by).orderBy(*([by] if by else []), *tree_order(order)).collect()
    return [r.line for r in rows]


def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def test_tree(spark):
    files = paths(spark, "src/main.rs", "README.md", "assets/logo.png", "src/a/b.rs")
    assert lines(files) == [
        "+ .", "- README.md", "+ assets", "  - logo.png", "+ src", "  + a", "    - b.rs", "  - main.rs",
    ]


def test_string_order_may_part_children_from_their_directory(spark):
    files = paths(spark, "src/main.rs", "src-x/f")
    assert lines(files) == ["+ .", "+ src", "+ src-x", "  - f", "  - main.rs"]
    assert lines(files, order="component") == ["+ .", "+ src", "  - main.rs", "+ src-x", "  - f"]


def test_leading_dot_and_root(spark):
    assert lines(paths(spark, "./src/main.rs")) == ["+ .", "  + src", "    - main.rs"]
    assert lines(paths(spark, "/abs/x")) == ["+ .", "+ /", "  + abs", "    - x"]


def test_file_and_directory_of_one_name(spark):
    files = paths(spark, "a", "a/b", "a")
    assert lines(files) == ["+ .", "+ a", "- a", "- a", "  - b"]


def test_no_files(spark):
    assert lines(spark.createDataFrame([], "path string")) == ["+ ."]


def test_directories_are_distinct_per_group(spark):
    files = spark.createDataFrame(
        [("p", "a/b/1"), ("p", "a/b/2"), ("q", "a/3")], "bundle string, path string"
    )
    assert sorted(tuple(r) for r in directories(files, "bundle").collect()) == [
        ("p", "a"), ("p", "a/b"), ("q", "a"),
    ]
    assert lines(files, "bundle") == ["+ .", "+ a", "  + b", "    - 1", "    - 2", "+ .", "+ a", "  - 3"]
    assert tree(files.drop("bundle")).where("is_dir").count() == 2


def test_directories_fold_before_the_shuffle(spark):
    plan = directories(paths(spark, "a/b"))._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange") :]
    assert "HashAggregate" in below


def test_tree_as_one_text(spark):
    files = spark.createDataFrame([("p", "a/b/1"), ("q", "2"), ("p", "a-b")], "bundle string, path string")
    assert {r.bundle: r.tree for r in tree_text(files, "bundle").collect()} == {
        "p": "+ .\n+ a\n- a-b\n  + b\n    - 1", "q": "+ .\n- 2",
    }


@pytest.mark.parametrize("by", [None, "k"])
def test_positions(spark, by):
    rows = spark.range(2000).selectExpr("id * 7919 % 2003 AS v", "IF(id % 3 = 0, 'x', 'y') AS k")
    got = sorted((r.k if by else "", r.position, r.v) for r in in_order(rows, ["v"], by).collect())
    values = {}
    for r in rows.collect():
        values.setdefault(r.k if by else "", []).append(r.v)
    assert got == sorted((k, i, v) for k, vs in values.items() for i, v in enumerate(sorted(vs)))
    assert in_order(rows.limit(0), ["v"], by).count() == 0


@pytest.mark.parametrize("by", [[], ["k"]])
def test_sums_before_every_partition(spark, monkeypatch, by):
    """Two levels of blocks, numbers left out, against a running total."""
    monkeypatch.setattr(ordering, "BLOCK", 4)
    rows = [(k, p, (7 * p + len(k)) % 5) for k in ("x", "yy") for p in range(41) if p % 3]
    if not by:
        rows = rows[: len(rows) // 2]
    got = ordering.before(spark.createDataFrame(rows, "k string, p long, n long").repartition(5), "p", "n", by, "b").collect()
    assert sorted((r.k, r.p, r.b) for r in got) == [(k, p, sum(n for j, q, n in rows if j == k and q < p)) for k, p, _ in rows]


def test_positions_cost_the_plan_nothing_per_partition(spark):
    sizes = []
    for parts in (4, 400):
        rows = spark.range(0, 1000, 1, parts).selectExpr("id")
        text = ordering.numbered(rows)._jdf.queryExecution().optimizedPlan().toString()
        sizes.append(len(text))
        got = ordering.numbered(rows)
        assert got.where("position != id").count() == 0 and got.count() == 1000
    assert abs(sizes[0] - sizes[1]) < 200
