"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from corpusloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(names, tuples):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(repr(tuple(t[i] for i in order)) for t in tuples)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = entry_points.queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    assert got[1]
    sql = entry_points.oracle_sql().get(name)
    if sql is None:
        assert name in ("file_scan", "file_admission")
        return
    expected = duck.sql(sql)
    assert got == rows(expected.columns, expected.fetchall())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_check_belongs_to_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_large_files_are_read_whole(spark):
    large = catalog.file_contents(spark, SF).where(f"size > {catalog.SMALL}")
    files = catalog.named_files(spark, SF).selectExpr("path", "md5(cast(content as binary)) AS md5")
    rows = large.where("status = 'text'").join(files, "path").collect()
    assert rows and all(r["digest"] == r["md5"] for r in rows)
    assert large.where("status = 'oversized'").count() == 0
