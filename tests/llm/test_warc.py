import hashlib
import io

import pytest
import zstandard

from corpusloom.llm import warc

BIG = "x" * 1500
ROWS = [
    (1, "http://a/", BIG), (9, "http://b/ ü\r\n", BIG), (5, None, BIG), (2, "u", None), (3, "u", ""), (4, "u", "small"), (6, "u", "small"),
    (7, "u", "ü" * 700), (8, "u", "ü" * 700), (None, "u", BIG), (None, None, None), (10, "u", "y" * 400_000), (11, "u", "GET / \r\n\r\nWARC/1.1\r\n" * 99),
    (12, "u", "z" * 1000), (12, "u", "z" * 1000), (13, "u", "w" * 999), (14, "u", "w" * 999),
]


@pytest.fixture(scope="module")
def pages(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    return df.selectExpr("*", "1 AS size", "2 AS winner", "3 AS payload", "4 AS archive").repartition(3)


def brute():
    best = {}
    for i, _, h in ROWS:
        if len((h or "").encode()) >= 1000 and i is not None:
            best[h] = max(best.get(h, i), i)
    out = []
    for i, _, h in ROWS:
        b, w = (h or "").encode(), best.get(h, i)
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "response" if w == i else "revisit", None if w == i else w))
    return sorted(map(repr, out))


def test_round_trip(pages):
    for options in ({}, {"frame_bytes": 1, "archive_bytes": 1}, {"frame_bytes": 5000, "archive_bytes": 3000}):
        got = warc.archive_round_trip(pages, **options).collect()
        assert sorted(repr(tuple(r)) for r in got) == brute()


def test_frames_go_on_across_batches(spark, pages, tmp_path):
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    try:
        for rows in (1, 2, 5):
            spark.conf.set(batch, rows)
            for options in ({}, {"frame_bytes": 1, "archive_bytes": 1}, {"frame_bytes": 5000, "archive_bytes": 3000}):
                got = warc.archive_round_trip(pages.coalesce(1), **options).collect()
                assert sorted(repr(tuple(r)) for r in got) == brute()
            index = warc.write_archives(pages.coalesce(1), str(tmp_path / str(rows)), frame_bytes=5000).collect()
            places = sorted((r["archive"], r["frame"], r["offset"], r["length"]) for r in index)
            for (archive, frame, offset, length), following in zip(places, places[1:], strict=False):
                assert (archive, frame) != following[:2] or following[2] == offset + length
    finally:
        spark.conf.set(batch, before)


def test_archives_are_plain_zstandard_with_a_seek_table(pages, tmp_path):
    index = warc.write_archives(pages, str(tmp_path / "w"), frame_bytes=2000).collect()
    names = {r["archive"] for r in index}
    for name in names:
        data = (tmp_path / "w" / name).read_bytes()
        text = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
        records = text.count(b"WARC-Record-ID: ")
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        assert records == 1 + sum(r["archive"] == name for r in index)


def test_one_record_by_its_index_row(pages, tmp_path):
    index = warc.write_archives(pages, str(tmp_path / "w"), frame_bytes=2000)
    got = warc.read_records(index.where("page_id = 10"), str(tmp_path / "w")).collect()
    assert [(r["record_id"], r["payload"]) for r in got] == [("10", b"y" * 400_000)]
    revisit = warc.read_records(index.where("page_id = 1"), str(tmp_path / "w")).first()
    assert (revisit["record_type"], revisit["refers_to"], revisit["payload_bytes"], revisit["payload"]) == ("revisit", "9", 1500, None)


def test_damage_is_noticed(spark, pages, tmp_path):
    index = warc.write_archives(pages.where("page_id = 10"), str(tmp_path / "w"))
    (file,) = (tmp_path / "w").glob("*.zst")
    data = bytearray(file.read_bytes())
    data[-13] ^= 1  # the checksum of the last frame
    file.write_bytes(data)
    with pytest.raises(Exception, match="damaged"):
        warc.read_records(index, str(tmp_path / "w")).collect()


def test_ids_of_any_text():
    for x in ("a b", "ü<>", "", "7", "no-page-id"):
        assert warc.page_of(f"<{warc.urn(x)}>") == x
    assert warc.page_of(f"<{warc.urn(None)}>") is None


def test_empty_table(pages):
    assert warc.archive_round_trip(pages.where("false")).count() == 0
