import hashlib

from pyspark.sql import functions as F

from corpusloom import catalog


def test_long_lines_are_moved_as_digests(spark, tmp_path, monkeypatch):
    """Lines read back are numbered without carrying long texts through the sort and the written rows."""
    lines = ["", "short", "é" * 16, "é" * 17, "x" * 32, "y" * 33, "z" * 10_000, ""]
    (tmp_path / "part-00000.txt").write_text("\n".join(lines[:5]) + "\n")
    (tmp_path / "part-00001.txt").write_text("\n".join(lines[5:]) + "\n")
    moved = []
    in_order = catalog.order.in_order

    def spied(rows, *args, **options):
        texts = [f.name for f in rows.schema if f.dataType.typeName() in ("string", "binary") and f.name != "file"]
        moved.append(rows.agg(*(F.max(F.octet_length(c)).alias(c) for c in texts)).first())
        return in_order(rows, *args, **options)

    monkeypatch.setattr(catalog.order, "in_order", spied)
    found = catalog._written_lines(spark, str(tmp_path)).orderBy("position").collect()
    assert max(n for row in moved for n in row) <= 32
    assert [tuple(r) for r in found] == [(i, hashlib.md5(line.encode()).hexdigest()) for i, line in enumerate(lines)]
