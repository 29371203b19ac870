import pytest
from pyspark.sql import functions as F

from corpusloom.functions.sniffing import looks_binary
from corpusloom.operators.admit import admit, flag_files, sample_files, status_counts


def admitted(spark, rows, **options):
    df = spark.createDataFrame(rows, "path string, raw binary, size bigint, read_error string")
    return {r.path: r for r in admit(df, **options).collect()}


def test_cascade_first_test_wins(spark):
    png = bytearray(b"\x89PNG\r\n\x1a\n")
    rows = [
        ("big.png", None, 100, None),
        ("equal.txt", bytearray(b"x" * 40), 40, None),
        ("over.txt", None, 41, None),
        ("name.SVG", None, 3, None),
        ("gone.txt", None, 3, "No such file"),
        ("lost.txt", None, 3, None),
        ("png", png, 8, None),
        ("nul.txt", bytearray(b"Hello\x00World"), 11, None),
        ("bad.txt", bytearray(b"\xff\xfeA"), 3, None),
        ("lone.txt", bytearray(b"\x80"), 1, None),
        ("ok.txt", bytearray("é".encode()), 2, None),
        ("empty", bytearray(b""), 0, None),
        ("marked.txt", bytearray(b"\xef\xbb\xbfa\x00"), 5, None),
        ("late.txt", bytearray(b"a" * 30 + b"\x00"), 31, None),
        ("x.css", bytearray(b"p{}"), 3, None),
    ]
    got = admitted(spark, rows, max_size=40)
    assert {p: (r.status, r.reason, r.content) for p, r in got.items()} == {
        "big.png": ("oversized", "oversize", "[file too large: 100 bytes]"),
        "equal.txt": ("text", "text", "x" * 40),
        "over.txt": ("oversized", "oversize", "[file too large: 41 bytes]"),
        "name.SVG": ("binary", "binary extension", "[binary skipped]"),
        "gone.txt": ("error", "read error", "[read error: No such file]"),
        "lost.txt": ("error", "read error", "[read error: no content]"),
        "png": ("binary", "binary content", "[binary skipped]"),
        "nul.txt": ("binary", "binary content", "[binary skipped]"),
        "bad.txt": ("binary", "invalid utf-8", "[binary skipped]"),
        "lone.txt": ("binary", "invalid utf-8", "[binary skipped]"),
        "ok.txt": ("text", "text", "é"),
        "empty": ("text", "text", ""),
        "marked.txt": ("text", "text", "﻿a\x00"),
        "late.txt": ("binary", "binary content", "[binary skipped]"),
        "x.css": ("text", "stylesheet", "p{}"),
    }


@pytest.mark.parametrize(
    "raw, binary",
    [
        (b"Hello, world!", False),
        (b"function main() { return 42; }", False),
        (b"\x89PNG\r\n\x1a\n", True),
        (b"GIF89a", True),
        (b"\x7fELF\x02", True),
        (b"%PDF-1.7", True),
        (b"PK\x03\x04rest", True),
        (b"\x1f\x8b\x08", True),
        (b"RIFF\x01\x01\x01\x01WEBPVP8", True),
        (b"abcdftypisom", True),
        (b"a" * 257 + b"ustar\x0000", True),
        (b"b" * 1024 + b"\x00", False),  # only the first 1024 bytes are looked at
        (b"", False),
    ],
)
def test_content_sniffing(spark, raw, binary):
    df = spark.createDataFrame([(bytearray(raw),)], "raw binary")
    assert df.select(looks_binary("raw")).first()[0] is binary


def test_flags_need_only_names_and_sizes(spark):
    rows = [(p, 5) for p in ("image.png", "video.mp4", "archive.zip", "font.ttf", "x.PNG")]
    rows += [(p, 6) for p in ("code.rs", "text.txt", "config.json", "readme.md", ".png", "Makefile")]
    got = flag_files(spark.createDataFrame(rows, "path string, size bigint"), 5).collect()
    assert {r.path for r in got if r.is_binary} == {p for p, n in rows if n == 5}
    assert {r.path for r in got if r.is_oversized} == {p for p, n in rows if n == 6}


def test_counts_and_sample(spark, corpus_of):
    files = {f"d{i}/f.txt": "x" * i for i in range(7)}
    files["a.png"] = "p"
    done = admit(corpus_of(files), max_size=5)
    assert {r.status: r.files for r in status_counts(done).collect()} == {
        "text": 6, "oversized": 1, "binary": 1,
    }
    assert [tuple(r) for r in sample_files(corpus_of(files), max_size=5).orderBy("position").collect()] == [
        (0, "a.png", "Binary: [binary skipped]"),
        (1, "d0/f.txt", "Text(0 chars)"),
        (2, "d1/f.txt", "Text(1 chars)"),
        (3, "d2/f.txt", "Text(2 chars)"),
        (4, "d3/f.txt", "Text(3 chars)"),
    ]


def test_filters_above_do_not_repeat_the_work(corpus_of):
    done = admit(corpus_of({"a.txt": "x"})).where("status = 'text' and reason = 'text'")
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("89504E47") == 1  # the signature test is planned once
    assert done.select(F.count("*")).first()[0] == 1
