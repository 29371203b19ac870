"""Operators run on workers that can't import this package: code goes with the tasks, data as plain arrays."""

import os
import subprocess
import sys
from pathlib import Path

HERE = Path(__file__).resolve().parents[2]

CODE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
    .config("spark.checkpoint.dir", {shared!r}).getOrCreate())

def alone(batches):
    import importlib.util
    for b in batches:
        yield b
    assert importlib.util.find_spec("corpusloom") is None

docs = spark.createDataFrame([(i, ("den und der ver " if i % 2 else "the of and ing ") * (9 + i), "de" if i % 2 else "en", "s", 3) for i in range(40)],
    "doc_id long, text string, lang string, source string, n_chars long")
docs.mapInArrow(alone, docs.schema).count()
vectors = spark.createDataFrame([(i, [i * 0.1, i * i * 0.01, -0.2 * i, (i % 7) * 0.3], i % 3) for i in range(40)], "vec_id long, embedding array<float>, label int")
pages = spark.createDataFrame([(i, "u", "html " * 300) for i in range(20)], "page_id long, url string, html string")
items = spark.createDataFrame([(1, "the of and ing the of and ing")], "item_id long, text string")
shared = {shared!r}
for name, df in dict(documents=docs, embeddings=vectors, pages=pages, benchmark=items).items():
    df.write.parquet(f"{{shared}}/tables/{{name}}.parquet")
from corpusloom.llm.queries import QUERIES
for name, query in QUERIES.items():
    rows = query(spark, f"{{shared}}/tables").collect()
    assert rows, name
    print("ran", name)
"""


def test_queries_on_bare_workers(tmp_path):
    code = CODE.format(repo=str(HERE), shared=str(tmp_path / "shared"))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    (tmp_path / "elsewhere").mkdir()
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "elsewhere", capture_output=True, text=True, env=env)
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.count("ran ") == 13
