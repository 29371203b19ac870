import os
from pathlib import Path

import pytest

from corpusloom.operators.admit import admit
from corpusloom.operators.snapshots import SubpathNotFound
from corpusloom.plans.ingest import ingest
from corpusloom.sources.files import list_files, read_corpus, read_files
from corpusloom.sources.tables import corpus_from_table

FILES = {
    ".git/config": b"x",
    ".git/info/exclude": b"*.exc\n",
    ".gitignore": b"node_modules/\n*.log\n!keep.log\n",
    "a.exc": b"",
    "x.log": b"l",
    "only": b"o",
    "sub/.git": b"gitdir: elsewhere",
    "sub/.gitignore": b"!x.log\n/only\n",
    "sub/keep.log": b"l",
    "sub/x.log": b"k",
    "sub/only": b"",
    "sub/node_modules/x/f.js": b"1",
    "_under/.hidden/empty": b"",
    "png": b"\x89PNG\r\n\x1a\n",
    "bad": b"\xff\xfeA",
    "big.txt": b"x" * 50,
    "logo.svg": b"<svg/>",
}
IGNORED = {".git/config", ".git/info/exclude", "a.exc", "x.log", "sub/only", "sub/node_modules/x/f.js"}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    for name, data in FILES.items():
        path = top / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    os.symlink(top / "sub", top / "link_to_dir")
    os.symlink(top / "only", top / "link_to_file")
    os.symlink("/nowhere/at/all", top / "broken")
    return str(top)


def test_listing_obeys_ignore_files(spark, root):
    got = {r.path: r.size for r in list_files(spark, root, root).collect()}
    expected = {p: len(d) for p, d in FILES.items() if p not in IGNORED}
    assert got == {**expected, "link_to_file": 1}


def test_listing_everything(spark, root):
    got = {r.path for r in list_files(spark, root, root, ignore_git=False).collect()}
    assert got == {*FILES, "link_to_file"}


def test_paths_without_a_base_and_single_files(spark, root):
    assert {r.path for r in list_files(spark, root).collect()} == {
        f"{root}/{p}" for p in [*(set(FILES) - IGNORED), "link_to_file"]
    }
    [row] = list_files(spark, f"{root}/only", root).collect()
    assert (row.path, row.absolute_path, row.size) == ("only", f"{root}/only", 1)
    with pytest.raises(FileNotFoundError):
        list_files(spark, f"{root}/missing")


def test_file_uri(spark, root):
    got = {r.path for r in list_files(spark, f"file://{root}/sub", f"file://{root}").collect()}
    assert "sub/keep.log" in got and "sub/only" not in got
    [row] = list_files(spark, f"file://{root}/only", f"file://{root}").collect()
    assert (row.path, row.size) == ("only", 1)
    with pytest.raises(FileNotFoundError):
        list_files(spark, f"file://{root}/missing")
    read = read_corpus(spark, f"file://{root}/sub", f"file://{root}")
    assert {r.path: r.content for r in admit(read).collect()}["sub/keep.log"] == "l"


def test_admitted_corpus(spark, root):
    got = {r.path: (r.status, r.content) for r in admit(read_corpus(spark, root, root, max_size=49), 49).collect()}
    assert got["_under/.hidden/empty"] == ("text", "")
    assert got["png"] == got["bad"] == got["logo.svg"] == ("binary", "[binary skipped]")
    assert got["big.txt"] == ("oversized", "[file too large: 50 bytes]")
    assert got["sub/.git"] == ("text", "gitdir: elsewhere")
    assert len(got) == len(FILES) - len(IGNORED) + 1


def test_failed_read_is_a_row(spark, root):
    listed = spark.createDataFrame([("gone", f"{root}/gone", 3)], "path string, absolute_path string, size bigint")
    [row] = admit(read_files(listed)).collect()
    assert row.status == "error" and row.content.startswith("[read error: ") and "gone" in row.content


def test_reads_are_cut_by_bytes(spark, tmp_path, monkeypatch):
    from corpusloom.sources import files

    monkeypatch.setattr(files, "_BATCH_BYTES", 100)
    for i in range(50):
        (tmp_path / f"f{i}").write_bytes(bytes([65 + i % 26]) * i)
    got = {r.path: bytes(r.raw) for r in read_corpus(spark, str(tmp_path), str(tmp_path)).collect()}
    assert got == {f"f{i}": bytes([65 + i % 26]) * i for i in range(50)}


def test_ingest(spark, root, tmp_path):
    ingest(spark, root, str(tmp_path / "doc"), base=root, max_size=49)
    text = "".join(p.read_text() for p in sorted(Path(tmp_path / "doc").glob("part-*")))
    assert text.startswith("## Directory Tree\n```text\n+ .\n- .gitignore\n+ _under\n  + .hidden\n    - empty\n")
    assert "### `big.txt`\n\n[file too large: 50 bytes]\n\n### `link_to_file`\n\n```\no\n```\n\n\n" in text
    assert "node_modules/x" not in text
    ingest(spark, root, str(tmp_path / "part"), base=root, subpath="sub/")
    text = "".join(p.read_text() for p in sorted(Path(tmp_path / "part").glob("part-*")))
    assert text.count("### `") == 4 and "### `sub/keep.log`" in text
    with pytest.raises(SubpathNotFound):
        ingest(spark, root, str(tmp_path / "none"), base=root, subpath="nope")


def test_corpus_from_table(spark):
    table = spark.createDataFrame([("a\\b.txt", "é", 7)], "p string, t string, k int")
    assert corpus_from_table(table, "p", "t", "k").first().asDict() == {
        "k": 7, "path": "a/b.txt", "content": "é", "size": 2,
    }


def put(top, files):
    for name, text in files.items():
        path = top / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return top


def test_git_rules_only_in_repositories(spark, tmp_path):
    top = put(tmp_path / "t", {".gitignore": "*.txt", "a.txt": "", "b.md": "", "r/.git/x": "", "r/.gitignore": "*.md", "r/c.md": "",
                               "r/d.txt": "", ".ignore": "*.tmp", "e.tmp": ""})
    got = {r.path for r in list_files(spark, str(top), str(top)).collect()}
    assert got == {".gitignore", ".ignore", "a.txt", "b.md", "r/.gitignore", "r/d.txt"}


def test_rules_above_the_source_and_a_global_file(spark, tmp_path):
    top = put(tmp_path / "t", {".git/x": "", ".gitignore": "*.log\n/deep/src/one", "deep/src/a.log": "", "deep/src/one": "", "deep/src/two": "",
                               "deep/src/x.bak": "", "deep/src/foo[": ""})
    put(tmp_path, {"rules": "*.bak\nfoo["})
    source = str(top / "deep/src")
    got = {r.path for r in list_files(spark, source, source, global_rules=str(tmp_path / "rules")).collect()}
    assert got == {"two", "foo["}
    put(tmp_path, {".ignore": "two"})
    assert {r.path for r in list_files(spark, source, source).collect()} == {"x.bak", "foo["}


def test_names_that_are_no_text(spark, tmp_path):
    folder = os.fsencode(tmp_path) + b"/caf\xe9"
    os.makedirs(folder + b"/sub\xff")
    for name in (b"/a.txt", b"/\xfe.txt", b"/sub\xff/b.txt"):
        with open(folder + name, "wb") as f:
            f.write(name)
    rows = read_corpus(spark, str(tmp_path), str(tmp_path)).collect()
    assert {r.path: bytes(r.raw) for r in rows} == {
        "caf\ufffd/a.txt": b"/a.txt", "caf\ufffd/\ufffd.txt": b"/\xfe.txt", "caf\ufffd/sub\ufffd/b.txt": b"/sub\xff/b.txt",
    }
    assert all(r.read_error is None for r in rows)


def test_filters_decide_before_a_file_is_opened(spark, tmp_path, monkeypatch):
    """Filters stand in the plan at the source; of what they exclude, nothing is opened, and rows are the same."""
    from pyspark.sql import datasource as D

    from corpusloom.sources import listed

    for i in range(40):
        (tmp_path / "in" / f"d{i % 3}").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / f"d{i % 3}" / f"{i}.txt").write_bytes(bytes([i]) * (10 * i))
    files = list_files(spark, str(tmp_path / "in"), str(tmp_path / "in"))
    folder = listed.commit_listing(files, str(tmp_path / "listing"))
    table = listed.read_listing(spark, folder)
    assert {(r.path, r.size, bytes(r.raw)) for r in table.collect()} == {(f"d{i % 3}/{i}.txt", 10 * i, bytes([i]) * (10 * i)) for i in range(40)}
    some = table.where("path LIKE 'd1/%' AND size > 50 AND size <= 200 AND length(raw) > 0")
    assert {r.size for r in some.collect()} == {10 * i for i in range(40) if i % 3 == 1 and 50 < 10 * i <= 200}
    plan = spark._jvm.PythonSQLUtils.explainString(some._jdf.queryExecution(), "formatted")
    for part in ("StringStartsWith(path,d1/)", "GreaterThan(size,50)", "LessThanOrEqual(size,200)"):
        assert part in plan.split("PushedFilters: ")[1].splitlines()[0]
    opened = []
    monkeypatch.setattr("corpusloom.sources.files._fetch", lambda path: opened.append(path) or b"x")
    reader = listed.Reader(folder)
    left = [*reader.pushFilters([D.GreaterThan(("size",), 350), D.StringEndsWith(("path",), "7.txt"), D.StringContains(("raw",), "a"),
                                 D.In(("size",), [370, 380, None]), D.IsNotNull(("path",)), D.Not(D.EqualTo(("size",), 1))])]
    assert [type(f).__name__ for f in left] == ["StringContains", "Not"]
    rows = [b for part in reader.partitions() for b in reader.read(part)]
    assert sum(map(len, rows)) == 1 and [p.rsplit("/", 1)[1] for p in opened] == ["37.txt"]


def test_one_directory_is_listed_in_pages(tmp_path, monkeypatch):
    """Names are handed on while the directory is still being read, and no size is asked for."""
    from corpusloom.sources import files as F

    read = []

    class Entry:
        def __init__(self, i):
            self.path = f"{tmp_path}/{i}"

        is_dir = is_symlink = lambda self: False

    class Listing:
        __enter__ = lambda self: self
        __exit__ = lambda *_: None

        def __iter__(self):
            for i in range(35):
                read.append(i)
                yield Entry(i)

    given = F.pa.RecordBatch.from_pydict({"absolute_path": [str(tmp_path)], "raw_path": F.pa.array([None], F.pa.binary())})
    seen = []
    with monkeypatch.context() as patch:
        patch.setattr(F, "_BATCH_ROWS", 10)
        patch.setattr(F.os, "scandir", lambda _: Listing())
        for page in F._list([given], True):
            seen.append((page.num_rows, len(read), page.column("size").null_count))
    assert seen == [(10, 10, 10), (10, 20, 10), (10, 30, 10), (5, 35, 5)]


def test_files_of_one_directory_are_looked_at_by_many_tasks(spark, tmp_path, caplog):
    for i in range(300):
        (tmp_path / f"f{i}").write_bytes(b"x" * i)
    (tmp_path / "gone").symlink_to(tmp_path / "nowhere")
    (tmp_path / "linked").symlink_to(tmp_path / "f7")
    (tmp_path / "d").mkdir()
    (tmp_path / "round").symlink_to(tmp_path / "d")
    listed = list_files(spark, str(tmp_path), str(tmp_path))
    got = {r["path"]: r["size"] for r in listed.collect()}
    assert got == {f"f{i}": i for i in range(300)} | {"linked": 7}
    assert len({f for f in listed.inputFiles()}) >= spark.sparkContext.defaultParallelism


def test_base_outside_the_source(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x").write_bytes(b"1")
    for base in (str(tmp_path / "b"), str(tmp_path / "a" / "deeper"), str(tmp_path) + "/a-"):
        [row] = list_files(spark, str(tmp_path / "a"), base).collect()
        assert row["path"] == f"{tmp_path}/a/x"
