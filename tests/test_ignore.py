import pytest
from pyspark.sql import functions as F

from corpusloom.operators.ignore import (
    drop_ignored,
    drop_vcs,
    ignored_files,
    in_repositories,
    parse_rules,
    rules_in_corpus,
)
from corpusloom.operators.skew import salt, spread_join


def rules_of(spark, lines):
    """Rules from (owner, kind, text of the rule file)."""
    rows = [
        (owner, kind, n, line)
        for owner, kind, text in lines
        for n, line in enumerate(text.split("\n"))
    ]
    return parse_rules(spark.createDataFrame(rows, "owner string, kind string, line_no int, line string"))


def ignored(spark, paths, *lines):
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    rows = ignored_files(files, rules_of(spark, lines)).collect()
    assert len(rows) == len(paths)
    return {r.path for r in rows if r.ignored}


CASES = [
    # rule text, ignored, kept
    ("*.log", ["a.log", "d/a.log"], ["a.logs", "log"]),
    ("/top", ["top", "top/x"], ["d/top"]),
    ("a/b", ["a/b", "a/b/c"], ["x/a/b"]),
    ("build/", ["build/x", "d/build/x"], ["build", "builds/x"]),
    ("**/tmp", ["tmp", "a/tmp", "a/b/tmp/x"], ["tmpx"]),
    ("a/**", ["a/x", "a/b/c"], ["a", "b/a"]),
    ("a/**/z", ["a/z", "a/b/z", "a/b/c/z"], ["az", "z"]),
    ("f?.txt", ["f1.txt", "d/f2.txt"], ["f.txt", "f12.txt"]),
    ("f[0-2].c", ["f0.c"], ["f3.c"]),
    ("f[!0-2].c", ["f3.c"], ["f0.c"]),
    ("*.txt\n!keep.txt", ["a.txt"], ["keep.txt", "d/keep.txt"]),
    ("d/\n!d/keep", ["d/keep", "d/x"], ["e"]),
    ("# note\n\n\\#odd\n\\!bang", ["#odd", "!bang"], ["# note", "note"]),
    ("trail  ", ["trail"], ["trail  "]),
    ("kept\\ ", ["kept "], ["kept"]),
    ("a.b+c(d)", ["a.b+c(d)"], ["axb+c(d)", "a.bbc(d)"]),
    ("star\\*", ["star*"], ["starry"]),
    ("dir/*", ["dir/x", "dir/sub/y"], ["x", "dir2/x"]),
    ("a**b", ["ab", "axxb"], ["a/b"]),
    ("x\r", ["x"], ["y"]),
    ("[]a]b", ["]b", "ab"], ["b"]),
    ("[^a]b", ["xb"], ["ab", "/b"]),
    ("[a^]b", ["^b", "ab"], ["xb"]),
    ("[a\\]]b", ["]b", "ab"], ["xb"]),
    ("[&&[]b", ["&b", "[b"], ["xb"]),
    ("a[/]b", [], ["a/b"]),
    ("/x*", ["x", "xy", "xd/f"], ["d/x", "yx"]),
    ("pre*", ["prefix", "d/pre", "pred/f"], ["apre"]),
    ("pre\\*", ["pre*"], ["prefix"]),
    ("pre\\\\*", ["pre\\x"], ["pre*", "prex"]),
    ("**/*.o", ["a.o", "d/b.o", "d/e/.o"], ["a.oo"]),
    ("**/a/b", ["a/b", "x/a/b/c"], ["a/xb", "b"]),
    ("lib/*/gen", ["lib/a/gen", "lib/b/gen/x"], ["lib/gen", "x/lib/a/gen"]),
    ("lib/gen/*.c\n!lib/gen/k*", ["lib/gen/a.c"], ["lib/gen/k.c", "lib/a.c"]),
    ("*", ["a", "d/b"], []),
    ("*" + "y" * 300, ["z" + "y" * 300], ["y" * 299]),
    ("foo[\n[z-a].txt\nx\\\n*.log", ["a.log"], ["foo[", "foo", "z.txt", "a.txt", "x", "x\\"]),
]


@pytest.mark.parametrize("text, gone, kept", CASES, ids=[c[0] for c in CASES])
def test_globs(spark, text, gone, kept):
    assert ignored(spark, gone + kept, ("", "gitignore", text)) == set(gone)


def test_nearer_rule_file_wins(spark):
    paths = ["x.log", "d/x.log", "d/e/x.log", "d/only", "only"]
    got = ignored(spark, paths, ("", "gitignore", "*.log"), ("d", "gitignore", "!x.log\n/only"),
                  ("d/e", "gitignore", "x.*"))
    assert got == {"x.log", "d/e/x.log", "d/only"}


def test_kinds_of_rule_file(spark):
    got = ignored(spark, ["a", "b", "c", "d/a"], ("", "ignore", "!a"), ("d", "gitignore", "a"),
                  ("", "gitignore", "a\nb"), ("", "exclude", "!b\nc"), ("", "global", "!c"))
    assert got == {"b", "c"}


def test_nothing_below_an_ignored_directory_comes_back(spark):
    got = ignored(spark, ["v/a/keep", "v/b"], ("", "gitignore", "v/a/"), ("v/a", "gitignore", "!keep"))
    assert got == {"v/a/keep"}


def test_rows_that_repeat_stay(spark):
    """As do null paths, paths at the top and other columns."""
    rows = [("a.o", 1), ("a.o", 1), ("a.o", 2), ("d/b", None), ("d/b", None), (None, 3), (None, 3), ("x/y/z", 4)]
    files = spark.createDataFrame(rows, "path string, size int")
    got = ignored_files(files, rules_of(spark, [("", "gitignore", "*.o\nx/\n"), ("q", "gitignore", "*")]))
    assert got.columns == ["path", "size", "ignored"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((p, n, p in ("a.o", "x/y/z"))) for p, n in rows)


def test_no_rules(spark):
    assert ignored(spark, ["a", "b/c"], ("", "gitignore", "# only a note\n")) == set()


def test_rules_come_from_the_corpus(spark, corpus_of):
    files = corpus_of({
        ".gitignore": "*.o\n", "lib/.ignore": "gen/\n", "lib/gen/x": "", "lib/a.o": "", "lib/b.c": "",
        ".git/info/exclude": "secret\n", "secret": "",
    })
    left = drop_ignored(files.select("path"), rules_in_corpus(files))
    assert {r.path for r in left.collect()} == {
        ".gitignore", "lib/.ignore", "lib/b.c", ".git/info/exclude",
    }


def test_vcs_directories(spark):
    paths = [".git/config", "a/.git/b/c", "a/.git", ".gitmodules", ".github/x"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path for r in drop_vcs(files).collect()} == {"a/.git", ".gitmodules", ".github/x"}


def test_a_directory_with_most_files_is_spread(spark):
    files = spark.range(3000).select(F.concat(F.lit("hot/f"), "id", F.lit(".log")).alias("path"))
    rules = rules_of(spark, [("", "gitignore", "*7.log\n")])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        done = ignored_files(files, rules)
        assert done.where("ignored").count() == 300
        assert done.select(F.spark_partition_id()).distinct().count() > 3
        assert done.count() == 3000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rules_of_version_control_need_a_repository(spark):
    rules = rules_of(spark, [("", "gitignore", "a"), ("r", "gitignore", "b"), ("r/s", "exclude", "c"), ("", "ignore", "d")])
    tops = spark.createDataFrame([("r",)], "owner string")
    left = in_repositories(rules, tops)
    assert {(r.owner, r.strength) for r in left.collect()} == {("r", 3), ("r/s", 2), ("", 4)}
    everywhere = in_repositories(rules, spark.createDataFrame([("",)], "owner string"))
    assert everywhere.count() == 4


def test_a_key_of_equal_rows_uses_all_salts(spark):
    """100,000 equal requests, whatever the hash of the row."""
    rows = spark.range(100_000).repartition(64).selectExpr("'r' AS repo", "'main' AS reference")
    assert rows.select(salt(["repo", "reference"], 16).alias("s")).distinct().count() == 16
    lookup = spark.createDataFrame([("r", "x")], "repo string, found string")
    met = spread_join(rows, lookup, ["repo"], salts=16)
    assert met.where("found = 'x'").count() == 100_000


def test_a_rule_file_of_many_lines(spark):
    """A line is looked up, not tried: 100,000 of them at the top, next to one pattern."""
    many = spark.range(100_000).selectExpr("'' AS owner", "'gitignore' AS kind", "id AS line_no",
                                           "concat(if(id % 2 = 0, '/d/n', 'm'), id) AS line")
    more = spark.createDataFrame([("", "gitignore", 200_000, "!m77??7")], many.schema)
    rules = parse_rules(many.union(more))
    files = spark.range(30_000).selectExpr("concat('d/', if(id % 3 = 0, 'n', if(id % 3 = 1, 'x/m', 'z')), id * 5) AS path")
    got = {r.path for r in ignored_files(files, rules).where("ignored").collect()}
    expected = set()
    for i in range(30_000):
        n = i * 5
        if i % 3 == 0 and n % 2 == 0 and n < 100_000 or i % 3 == 1 and n % 2 and n < 100_000 and not (
            str(n).startswith("77") and str(n).endswith("7") and len(str(n)) == 5
        ):
            expected.add(f"d/{'n' if i % 3 == 0 else 'x/m'}{n}")
    assert got == expected


def test_no_rules_are_copied_next_to_directories(spark):
    """The rules themselves are in no aggregate: a directory holds names of directories only."""
    files = spark.createDataFrame([("a/b",)], "path string")
    plan = ignored_files(files, rules_of(spark, [("", "gitignore", "x\n*.y\nz?")]))._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        assert "collect_list" not in line and ("collect_set" not in line or "regex" not in line)


def test_matches_are_dealt_out_before_they_are_gathered(spark):
    """No task gathers the files of its own split: what it would hold grows with the split."""
    files = spark.createDataFrame([("a/x.txt",), ("a/x.txt",), ("b/y.txt",)], "path string")
    done = ignored_files(files, rules_of(spark, [("", "gitignore", "*.txt\n!y.txt")]))
    text = done._jdf.queryExecution().executedPlan().toString()
    gathered = text[text.index("count_if") if "count_if" in text else text.index("max_by("):]
    assert "REPARTITION_BY_COL" in gathered
    assert sorted((r.path, r.ignored) for r in done.collect()) == [("a/x.txt", True), ("a/x.txt", True), ("b/y.txt", False)]
