import random

import pytest
from pyspark.errors import AnalysisException

from corpusloom.plans import written
from corpusloom.plans.documents import tree_parts, whole_documents, write_document
from corpusloom.operators.tree import tree_text

FILES = [(f"d{i % 7}/é{i}.txt", f"text {i} " + "ü" * (i * 37 % 400)) for i in range(120)]


def joined(pieces):
    return b"".join(bytes(r["data"]) for r in sorted(pieces.collect(), key=lambda r: r["start"]))


@pytest.fixture(scope="module")
def committed(spark, corpus_of, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("written") / "doc")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    parts = written.commit_document(corpus_of(FILES), folder, format="json")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    names = [r["file"].removeprefix("file:") for r in parts.orderBy("position").collect()]
    return folder, parts, b"".join(open(n, "rb").read() for n in names)


def test_manifest_gives_the_document(spark, corpus_of, committed):
    folder, parts, data = committed
    [row] = whole_documents(corpus_of(FILES).selectExpr("*", "'x' AS by"), "by", format="json").collect()
    assert data.decode() == row["document"] + "\n"
    rows = parts.orderBy("position").collect()
    assert [r["start"] for r in rows] == [sum(r["bytes"] for r in rows[:i]) for i in range(len(rows))]
    assert joined(written.read_bytes(spark, folder)) == data


def test_ranges(spark, committed, monkeypatch):
    monkeypatch.setattr(written, "CHUNK", 1000)
    folder, _, data = committed
    n, pick = len(data), random.Random(3)
    asked = [(None, pick.randrange(n), pick.randint(1, 5000)) for _ in range(40)]
    asked += [asked[0], (None, 0, n), (None, n - 1, 9), (None, 0, 1)]
    nothing = [(None, n, 5), (None, 9 * n, 5), (None, 3, 0), (None, -1, 4), (None, None, 4), ("other", 0, 4)]
    got = {}
    for r in written.read_ranges(spark, folder, spark.createDataFrame(asked + nothing, written._RANGES)).collect():
        got.setdefault((r["document"], r["start"], r["length"]), []).append((r["part"], bytes(r["data"])))
    assert {k: b"".join(d for _, d in sorted(v)) for k, v in got.items()} == {
        (k, s, m): data[s : s + m] for k, s, m in asked
    }
    for s, m in ((0, 0), (5, 2500), (n - 3, 100), (n + 1, 3)):
        assert joined(written.read_bytes(spark, folder, s, m)) == data[s : s + m]
    with pytest.raises(ValueError):
        written.read_bytes(spark, folder, -1)


def test_only_files_of_the_range_are_opened(spark, committed):
    folder, parts, data = committed
    rows = parts.orderBy("position").collect()
    assert len(rows) > 2
    plan = written.read_bytes(spark, folder, 10, 20)._jdf.queryExecution().toString()
    assert "LessThan(start,30)" in plan
    second = rows[1]["start"]
    held = [r for r in rows if r["start"] < second + 4 and r["start"] + r["bytes"] > second]
    assert len(held) < len(rows) and joined(written.read_bytes(spark, folder, second, 4)) == data[second : second + 4]


def test_documents_by_value_and_no_manifest(spark, corpus_of, tmp_path):
    corpus = corpus_of(FILES).selectExpr("*", "CASE split(path, '/')[0] WHEN 'd1' THEN 'a+b c%/é' WHEN 'd2' THEN null ELSE 'rest' END AS kind")
    folder = str(tmp_path / "by")
    parts = written.commit_document(corpus, folder, by="kind", format="md")
    assert {r["document"] for r in parts.collect()} == {"a+b c%/é", None, "rest"}
    for name in ("a+b c%/é", "rest"):
        [row] = whole_documents(corpus.where(corpus.kind == name), "kind", format="md").collect()
        assert joined(written.read_bytes(spark, folder, document=name)).decode() == row["document"]
    open_folder = str(tmp_path / "open")
    write_document(corpus_of(FILES), open_folder)
    with pytest.raises(AnalysisException):
        written.manifest(spark, open_folder)


def test_trees_in_parts(corpus_of):
    files = corpus_of(FILES + [("x", "1"), ("", "odd")]).selectExpr("*", "length(path) % 3 AS kind")
    whole = {str(r["kind"]): r["tree"] for r in tree_text(files, "kind").collect()}
    rows = sorted(tree_parts(files, "kind", cell_bytes=100).collect(), key=lambda r: (r["kind"], r["part"]))
    assert len(rows) > 6
    assert {k: "".join(r["tree"] for r in rows if r["kind"] == k) for k in whole} == whole
    with pytest.raises(ValueError, match="more than 50"):
        tree_text(files, "kind", limit=50)
