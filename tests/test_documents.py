import json
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.operators.rules import REDACTED, Rule
from corpusloom.plans import documents
from corpusloom.plans.documents import (
    assemble,
    document_totals,
    numbered_pieces,
    pieces,
    section,
    whole_documents,
    write_document,
)

FILES = {
    "src/main.rs": 'fn main() {\n    println!("Hello");\n}',
    "README.md": "# Test\npassword=abc",
    "assets/logo.png": "zz",
    "src-x/fence.html": 'a```\n</file> "q" & <style>p</style>',
    'odd"name.txt': "",
    "big.txt": "x" * 100,
}
TREE = """+ .
- README.md
+ assets
  - logo.png
- big.txt
- odd"name.txt
+ src
+ src-x
  - fence.html
  - main.rs"""
MARKDOWN = f"""## Directory Tree
```text
{TREE}
```

---

### `README.md`

```markdown
# Test
{REDACTED}
```


### `assets/logo.png`

[binary skipped]

### `big.txt`

[file too large: 100 bytes]

### `odd"name.txt`

```

```


### `src/main.rs`

```rust
fn main() {{
    println!("Hello");
}}
```


### `src-x/fence.html`

```html
a```
</file> "q" & <style>…</style>
```


"""
XML = f"""<instructions>Read all code before answering.</instructions>

<directory_tree>
{TREE}
</directory_tree>

<file path="README.md">
# Test
{REDACTED}
</file>

<file path="assets/logo.png">[binary skipped]</file>

<file path="big.txt">[file too large: 100 bytes]</file>

<file path="odd"name.txt">

</file>

<file path="src/main.rs">
fn main() {{
    println!("Hello");
}}
</file>

<file path="src-x/fence.html">
a```
</file> "q" & <style>…</style>
</file>

"""
RECORDS = [
    {"path": "README.md", "content": f"# Test\n{REDACTED}"},
    {"path": "assets/logo.png", "content": "[binary skipped]"},
    {"path": "big.txt", "content": "[file too large: 100 bytes]"},
    {"path": 'odd"name.txt', "content": ""},
    {"path": "src/main.rs", "content": FILES["src/main.rs"]},
    {"path": "src-x/fence.html", "content": 'a```\n</file> "q" & <style>…</style>'},
]


@pytest.fixture(scope="module")
def bundles(corpus_of):
    """The files as bundle one, and a single file as bundle two."""
    one = corpus_of(FILES).withColumn("bundle", F.lit("one"))
    return one.unionByName(corpus_of({"z.py": "1"}).withColumn("bundle", F.lit("two")))


def read(folder):
    return "".join(p.read_text() for p in sorted(Path(folder).glob("part-*")))


def joined(rows):
    """Document by bundle, from parts in order, and the number of parts."""
    out, parts = {}, {}
    for r in sorted(rows, key=lambda r: (r.bundle, r.part)):
        out[r.bundle] = out.get(r.bundle, "") + r.document
        parts[r.bundle] = parts.get(r.bundle, 0) + 1
    return out, parts


@pytest.mark.parametrize("format, expected", [("md", MARKDOWN), ("xml", XML), ("unknown", MARKDOWN)])
def test_documents(bundles, format, expected):
    out, parts = joined(assemble(bundles, "bundle", format=format, max_size=99).collect())
    assert out["one"] == expected
    assert parts == {"one": 1, "two": 1}
    assert "z.py" in out["two"] and "README" not in out["two"]


def test_json_document(bundles):
    out, _ = joined(assemble(bundles, "bundle", format="json", max_size=99).collect())
    ordered = [{"content": r["content"], "path": r["path"]} for r in RECORDS]
    expected = json.dumps({"directory_tree": TREE, "files": ordered}, indent=2, ensure_ascii=False)
    assert out["one"] == expected
    assert json.loads(out["two"]) == {
        "directory_tree": "+ .\n- z.py", "files": [{"content": "1", "path": "z.py"}],
    }


@pytest.mark.parametrize("format", ["md", "xml", "json"])
def test_large_documents_come_in_parts(bundles, format):
    whole, _ = joined(assemble(bundles, "bundle", format=format, max_size=99).collect())
    cut = assemble(bundles, "bundle", format=format, max_size=99, cell_bytes=200)
    out, parts = joined(cut.collect())
    assert out == whole
    assert parts["one"] > 1 and parts["two"] == 1


@pytest.mark.parametrize("format", ["md", "xml", "json"])
def test_totals_are_those_of_the_document(bundles, format):
    whole, _ = joined(assemble(bundles, "bundle", format=format).collect())
    got = {r.bundle: r for r in document_totals(bundles, by="bundle", format=format).collect()}
    for name, text in whole.items():
        n = len(text.encode())
        assert (got[name].bytes, got[name].tokens) == (n, -(-n * 13 // 40))
    assert got["one"].files == len(FILES)


def test_written_document(bundles, corpus_of, tmp_path):
    write_document(corpus_of(FILES), str(tmp_path / "md"), max_size=99)
    assert read(tmp_path / "md") == MARKDOWN
    write_document(bundles, str(tmp_path / "xml"), by="bundle", format="xml", max_size=99)
    assert read(tmp_path / "xml" / "bundle=one") == XML
    write_document(bundles, str(tmp_path / "json"), by="bundle", format="json", max_size=99)
    text = read(tmp_path / "json" / "0-tree" / "bundle=one") + read(tmp_path / "json" / "1-files" / "bundle=one")
    expected = [{"content": r["content"], "path": r["path"]} for r in RECORDS]
    whole = json.dumps({"directory_tree": TREE, "files": expected}, indent=2, ensure_ascii=False)
    assert text == whole + "\n"
    write_document(corpus_of(FILES), str(tmp_path / "one"), format="json", max_size=99)
    assert read(tmp_path / "one" / "0-tree") + read(tmp_path / "one" / "1-files") == whole + "\n"
    write_document(corpus_of({"a": "x"}).limit(0), str(tmp_path / "none"), format="json")
    text = read(tmp_path / "none" / "0-tree") + read(tmp_path / "none" / "1-files")
    assert json.loads(text) == {"directory_tree": "+ .", "files": []}


def test_parts_are_numbered_and_whole_documents_must_fit(bundles):
    parts = assemble(bundles, "bundle", max_size=99, cell_bytes=150)
    assert dict(parts.dtypes)["part"] == "bigint"
    numbers = sorted(r.part for r in parts.where("bundle = 'one'").collect())
    assert numbers == [*range(len(numbers))] and len(numbers) > 2
    placed = numbered_pieces(bundles, "bundle", max_size=99).where("bundle = 'one'").orderBy("position").collect()
    assert "".join(r.piece for r in placed) == MARKDOWN
    assert [r.position for r in placed] == [*range(len(placed))]
    whole = {r.bundle: r.document for r in whole_documents(bundles, "bundle", max_size=99).collect()}
    assert whole["one"] == MARKDOWN
    with pytest.raises(ValueError, match="'one' has"):
        whole_documents(bundles, "bundle", max_size=99, limit=300)


def test_rules_that_make_texts_longer_make_more_parts(corpus_of):
    """Parts go by rewritten bytes: a match of one byte becomes twenty."""
    files = corpus_of({f"f{i:03}": "a" * 200 for i in range(200)}).withColumn("bundle", F.lit("x"))
    parts = assemble(files, "bundle", rules=[Rule("redact", "a")], cell_bytes=30_000).collect()
    assert len(parts) > 20 and max(len(r.document.encode()) for r in parts) < 40_000


@pytest.fixture
def many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_written_order_over_many_tasks(spark, tmp_path, many_tasks):
    n = 5000
    files = spark.range(n).select(
        F.concat(F.lit("d"), F.pmod("id", F.lit(3)), F.lit("/"), "id").alias("path"),
        F.concat(F.lit("text "), "id").alias("content"),
        F.lit(9).cast("bigint").alias("size"),
        (F.col("id") > 10).cast("string").alias("half"),  # nearly all in one bundle
    )
    write_document(files, str(tmp_path / "all"))
    text = read(tmp_path / "all")
    names = [line[5:-1] for line in text.splitlines() if line.startswith("### ")]
    assert names == sorted((f"d{i % 3}/{i}" for i in range(n)), key=lambda p: p.split("/"))
    write_document(files, str(tmp_path / "by"), by="half")
    text = read(tmp_path / "by" / "half=true")
    names = [line[5:-1] for line in text.splitlines() if line.startswith("### ")]
    assert names == sorted((f"d{i % 3}/{i}" for i in range(11, n)), key=lambda p: p.split("/"))
    assert len(list((tmp_path / "by" / "half=true").glob("part-*"))) > 1
    out, parts = joined(
        assemble(files.withColumnRenamed("half", "bundle"), "bundle", cell_bytes=50_000).collect()
    )
    assert out["true"] == text and parts["true"] > 1 and parts["false"] == 1


def test_tree_order_option(corpus_of, tmp_path):
    files = corpus_of({"src/main.rs": "", "src-x/f": ""})
    write_document(files, str(tmp_path / "t"), tree="component")
    assert "+ src\n  - main.rs\n+ src-x\n" in read(tmp_path / "t")


def test_escaped_xml(spark):
    df = spark.createDataFrame([('a"&.x', "text", "<b> & </file>")], "path string, status string, content string")
    assert df.select(section("xml", escape=True)).first()[0] == (
        '<file path="a&quot;&amp;.x">\n&lt;b&gt; &amp; &lt;/file&gt;\n</file>\n\n'
    )


def test_rules_run_after_the_sort(corpus_of):
    """The sort samples its input, so the rules belong above it."""
    plan = pieces(corpus_of(FILES))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("rangepartitioning")
    assert "ArrowEvalPython" not in plan[plan.index("rangepartitioning") :]


def test_cells_are_joined_a_few_at_a_time(monkeypatch):
    """The cells of a batch come in several steps, and are those that one step gave."""
    names = pa.array([n for n in "aaabbc" for _ in range(20)])
    texts = pa.array([str(i) * (i % 7) for i in range(len(names))])
    batch = pa.RecordBatch.from_arrays([names, texts], ["by", "piece"])

    def cells(step):
        monkeypatch.setattr(documents, "_JOINED", step)
        found = [*documents._cut([batch, batch.slice(3, 50)], "by", 60)]
        return len(found), [tuple(r.values()) for b in found for r in b.to_pylist()]

    steps, whole = cells(1 << 20)
    assert steps == 2 and all(len(text) < 60 + 18 for _, text in whole)
    many, parts = cells(100)
    assert many > 4 and parts == whole
    assert "".join(t for _, t in parts) == "".join(texts.to_pylist() + texts.slice(3, 50).to_pylist())
