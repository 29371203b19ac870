"""The queries: against their SQL, the pipeline stage by stage, and what a lost subpackage leaves."""

import os
import subprocess
import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from corpusloom.llm import checks, queries

SF = "/root/testdata/sf0.001"
HERE = Path(__file__).resolve().parents[2]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "documents embeddings pages benchmark".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(names, tuples):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(repr(tuple(t[i] for i in order)) for t in tuples)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    assert got[1]
    if name in checks.SQL:
        expected = duck.sql(checks.SQL[name])
        assert got == rows(expected.columns, expected.fetchall())


def test_all_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == [*range(1, 14)]
    assert {*queries.QUERIES, "pipeline"} <= {*entry_points.queries()}
    assert {*checks.SQL} <= {*entry_points.oracle_sql()}


def test_pipeline(spark, duck):
    """Each stage's decision, recomputed on its own input; the last by the tokenizer itself."""
    from tokenizers import Tokenizer

    from corpusloom.llm import decontaminate, language, mixing, neardup
    from corpusloom.llm.shared import keep

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    (_, s1), (_, s2), (_, s3), (_, s4), (_, s5) = corpus_pipeline.STAGES
    told = language.identify_languages(docs).where("lang_pred != 'und' and not ambiguous")
    one = keep(s1(spark, docs, SF))
    assert ids(one) == ids(told) and one.columns == docs.columns
    two = keep(s2(spark, one, SF))
    assert ids(two) == ids(neardup.near_duplicates(one).where("kept"))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    three = keep(s3(spark, two, SF))
    assert ids(three) == ids(decontaminate.leak_report(two, bench).where("not leaked"))
    assert three.count() < two.count() < one.count()
    four = keep(s4(spark, three, SF))
    often = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(three).collect()}
    assert ids(four) == sorted(i for i, c in often.items() for _ in range(c))
    library, at = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json")), 0
    got = sorted(map(tuple, s5(spark, four, SF).select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
    for (start, i, n, crc), (j, t) in zip(got, sorted((r["doc_id"], r["text"]) for r in four.collect()), strict=True):
        tokens = library.encode(t, add_special_tokens=False).ids + [2]
        assert (start, i, n, crc) == (at, j, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes()))
        at += n
    whole = sorted(map(tuple, corpus_pipeline.run(spark, SF).select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
    assert whole == got


def test_the_rest_stands_without_this_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "corpusloom"):
        os.symlink(HERE / name, tmp_path / name) if name.endswith(".py") else None
    package = tmp_path / "corpusloom"
    package.mkdir()
    for x in (HERE / "corpusloom").iterdir():
        if x.name not in ("llm", "__pycache__"):
            os.symlink(x, package / x.name)
    code = f"import sys; sys.path[:0] = [{str(tmp_path)!r}]; import runpy; m = runpy.run_path({str(tmp_path / '__spark_entry__.py')!r}); q = m['queries'](); assert 'pipeline' not in q and 'md_sections' in q, q.keys()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, env=env)
    assert done.returncode == 0, done.stderr
