from pyspark.sql import functions as F

from corpusloom.functions import paths
from corpusloom.functions.languages import fence_language


def values(spark, given, expression):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, path string")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_extension(spark):
    given = [".png", "a.", "x/..png", "a.tar.GZ", "Makefile", "d.x/f", "a/b.rs", "a\n.b", "c.d\n"]
    expected = ["", "", "png", "GZ", "", "", "rs", "b", "d\n"]
    assert values(spark, given, paths.extension("path")) == expected


def test_normalize_and_name(spark):
    assert values(spark, ["a\\b\\c.txt", "a/b"], paths.normalize_path("path")) == ["a/b/c.txt", "a/b"]
    assert values(spark, ["a/b/c.txt", "x"], paths.file_name("path")) == ["c.txt", "x"]
    assert values(spark, ["a/b/c.txt", "x", "/r"], paths.parent("path")) == ["a/b", "", ""]


def test_relative_to_strips_whole_components(spark):
    given = ["/base/a/b", "/base2/a", "/base", "rel/a"]
    assert values(spark, given, paths.relative_to("path", "/base/")) == ["a/b", "/base2/a", "", "rel/a"]
    assert values(spark, given, paths.relative_to("path", "")) == given


def test_ancestors(spark):
    given = ["a/b/c.txt", "./src/main.rs", "/abs/x", "top"]
    expected = [["a", "a/b"], ["./src"], ["/", "/abs"], []]
    assert values(spark, given, paths.ancestors("path")) == expected


def test_depth_counts_leading_dot_and_root(spark):
    given = ["a/b", "./src/main.rs", "/abs/x", "/", "top"]
    assert values(spark, given, paths.depth("path")) == [2, 3, 3, 1, 1]


def test_path_key_orders_by_component(spark):
    given = ["a.txt", "a-x/f", "a/b", "a", "a/b/c", "a/b-c", "./z"]
    df = spark.createDataFrame([(p,) for p in given], "path string")
    by_key = [r.path for r in df.orderBy(paths.path_key("path")).collect()]
    assert by_key == sorted(given, key=lambda p: p.split("/"))
    by_string = [r.path for r in df.orderBy("path").collect()]
    assert by_string == sorted(given) != by_key


def test_fence_language_is_case_sensitive(spark):
    given = ["a.rs", "a.RS", "b.tfvars", "c.unknown", "Makefile", "d/x.markdown"]
    assert values(spark, given, fence_language("path")) == ["rust", "", "hcl", "", "", "markdown"]


def test_under_directory(spark):
    given = [".git/config", "a/.git/b", "a/.git", ".gitignore", "a/.github/x"]
    got = values(spark, given, paths.under_directory(F.col("path"), ".git"))
    assert got == [True, True, False, False, False]
