import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.operators import engine
from corpusloom.operators.admit import admit
from corpusloom.operators.matches import (
    line_table,
    match_counts,
    match_headers,
    match_table,
    matches_by_line,
    show_matches,
)
from corpusloom.operators.rules import Rule

PAIR = Rule("redact", r"(?i)(password|api_key)\s*[:=]\s*\S+")


def by_hand(text, rules):
    """(rule_id, start, len, char_start, line_no, offset) with plain Python."""
    out = []
    for n, rule in enumerate(rules, 1):
        for m in re.finditer(rule.pattern, text):
            head = text[: m.start()]
            line = head.rsplit("\n", 1)[-1]
            out.append((n, len(head.encode()), len(m[0].encode()), m.start(),
                        head.count("\n") + 1, len(line.encode())))
        text = re.sub(rule.pattern, lambda _: rule.replacement, text)
    return out


def found(files, rules):
    rows = match_table(files, rules).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.rule_id, r.start)):
        got.setdefault(r.path, []).append(
            (r.rule_id, r.start, r.len, r.char_start, r.line_no, r.line_offset)
        )
    return got


def test_byte_spans(corpus_of):
    text = "é password=x\nb api_key = zz"
    got = found(admit(corpus_of({"a.txt": text})), [PAIR])
    assert got == {"a.txt": [(1, 3, 10, 2, 1, 3), (1, 16, 12, 15, 2, 2)]}


def test_positions_agree_with_plain_python(corpus_of):
    rules = [PAIR, Rule("truncate", "…?<b>.*?</b>"), Rule("redact", "RED.*\n?x"), Rule("truncate", "[éü]+\n*")]
    texts = {
        "a": "password=1\n\nüapi_key:\n 2 <b>é</b>\nx",
        "b": "<b></b>" * 50 + "\npassword=é\nx",
        "c": "\n\n\né\n\néé password=password=x",
        "d": "nothing here",
        "e": "",
        "f": "password=a\r\napi_key=b\r\n",
    }
    got = found(admit(corpus_of(texts)), rules)
    assert got == {k: v for k, v in ((k, by_hand(t, rules)) for k, t in texts.items()) if v}


def test_many_matches_in_one_file(corpus_of):
    text = "".join(f"k{i}é=password={i}\n" for i in range(3000))
    rules = [Rule("redact", r"password=\d+")]
    got = found(admit(corpus_of({"a": text})), rules)
    assert got == {"a": by_hand(text, rules)}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab\né=<", max_size=40), min_size=1, max_size=20))
def test_random_texts(corpus_of, texts):
    rules = [Rule("redact", "a=\n?"), Rule("truncate", "b+<"), Rule("redact", "\n+é")]
    files = {f"f{i}": t for i, t in enumerate(texts)}
    got = found(admit(corpus_of(files)), rules)
    assert got == {k: v for k, v in ((k, by_hand(t, rules)) for k, t in files.items()) if v}


def test_safe_table_carries_no_text(corpus_of):
    files = admit(corpus_of({"a.txt": "door=4\npassword=pqrs-tuvw-5678\nfloor=2"}))
    assert "text" not in match_table(files, [PAIR]).columns
    [row] = show_matches(files, [PAIR]).collect()
    assert (row.line_no, row.shown) == (2, "[characters 1-23]")
    assert row.message == "  Redaction match at line 2: '[characters 1-23]'"


def test_unsafe_log_cuts_long_text(corpus_of):
    files = admit(corpus_of({"a.htm": "{{" + "n" * 150 + "}} {{m}}"}))
    rows = show_matches(files, [Rule("truncate", r"\{\{.*?\}\}", r"\.htm$")], safe=False)
    shown = [r.shown for r in rows.orderBy("start").collect()]
    assert shown == ["{{" + "n" * 95 + "...", "{{m}}"]


def test_match_over_lines_and_at_a_break(corpus_of):
    files = admit(corpus_of({"a.txt": "x\npassword=\n  yy"}))
    [row] = show_matches(files, [PAIR]).collect()
    assert (row.line_no, row.shown) == (2, "[characters 1-14]")
    assert show_matches(files, [Rule("redact", r"\np")]).count() == 0
    assert match_table(files, [Rule("redact", r"\np")]).count() == 1


def test_headers_and_lines(corpus_of):
    files = admit(corpus_of({"c.txt": "password=a api_key=b\npassword=c"}))
    [head] = match_headers(files, [PAIR]).collect()
    assert head.message == (
        f"Filter applied: Redaction pattern '{PAIR.pattern}' matched 3 time(s) in c.txt"
    )
    rows = matches_by_line(files, [PAIR]).orderBy("line_no").collect()
    assert [(r.line_no, r.matches, r.shown) for r in rows] == [
        (1, 2, ["[characters 1-10]", "[characters 12-20]"]), (2, 1, ["[characters 1-10]"]),
    ]


def test_empty_matches(corpus_of):
    """Word boundaries and optional repeats: matches of length 0, at their places."""
    files = admit(corpus_of({"a": "ab cd", "b": "x\n"}))
    got = found(files, [Rule("redact", r"\b")])
    assert [r[1:3] for r in got["a"]] == [(0, 0), (2, 0), (3, 0), (5, 0)]
    assert [r[1:3] for r in found(files, [Rule("truncate", "y*")])["b"]] == [(0, 0), (1, 0), (2, 0)]
    shown = show_matches(files, [Rule("redact", r"\b")]).where("path = 'a'").orderBy("start").collect()
    assert [(r.start, r.line_no) for r in shown] == [(0, 1), (2, 1), (3, 1)]  # the last is behind the line
    assert {r.path: r.matches for r in match_counts(files, [Rule("redact", r"\b")]).collect()} == {"a": 4, "b": 2}


def test_long_text_is_cut_by_bytes(corpus_of):
    files = admit(corpus_of({"a": f"<{'é' * 60}> <{'x' * 98}> <{'x' * 99}> <{'😀' * 30}>"}))
    rows = show_matches(files, [Rule("truncate", "<[^>]*>")], safe=False).orderBy("start").collect()
    assert [r.shown for r in rows] == [
        f"<{'é' * 48}...", f"<{'x' * 98}>", f"<{'x' * 96}...", f"<{'😀' * 24}...",
    ]


def test_lines_are_grouped_without_moving_rows(corpus_of):
    files = admit(corpus_of({"a": "k1 k2\n\nk3 q k4", "b": "q"}))
    rules = [Rule("redact", r"k\d"), Rule("truncate", "q"), Rule("redact", "\n")]
    got = matches_by_line(files, rules, safe=False)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.path, r.rule_id, r.line_no, r.matches, tuple(r.shown)) for r in got.collect()) == [
        ("a", 1, 1, 2, ("k1", "k2")), ("a", 1, 3, 2, ("k3", "k4")), ("a", 2, 3, 1, ("q",)), ("b", 2, 1, 1, ("q",)),
    ]


def test_line_table(corpus_of):
    rows = line_table(corpus_of({"a": "é\n\nxy\r\nz\n", "b": "", "c": "\n", "d": "x"})).orderBy("path", "line_no").collect()
    assert [(r.path, r.line_no, r.start, r.len, r.line) for r in rows] == [
        ("a", 1, 0, 2, "é"), ("a", 2, 3, 0, ""), ("a", 3, 4, 3, "xy\r"), ("a", 4, 8, 1, "z"),
        ("c", 1, 0, 0, ""), ("d", 1, 0, 1, "x"),
    ]


def test_time_grows_with_the_lines(corpus_of):
    def seconds(n):
        files = corpus_of({"a": "x\n" * n}).cache()
        files.count()
        start = time.perf_counter()
        line_table(files).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(1_000_000) < 3 * seconds(300_000) + 5


def test_no_shuffle(corpus_of):
    plan = match_table(admit(corpus_of({"a": "x"})))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_slices_and_marks_in_the_text(corpus_of, monkeypatch):
    """Texts that hold characters of private use, slices of a few bytes, and rules on what others left."""
    monkeypatch.setattr(engine, "_SLICE", 64)
    monkeypatch.setattr(engine, "_PRIVATE", np.arange(0xF0000, 0xF0004))
    rules = [Rule("redact", "\U000F0000?é+"), Rule("truncate", "b\n?"), Rule("redact", "██R")]
    texts = {f"f{i}": "a\U000F0000é\nb" * (i % 7) + chr(0xF0000 + i % 4) + "é" * (i % 3) + "\U0010FFFDb\n" for i in range(40)}
    assert found(admit(corpus_of(texts)), rules) == {k: v for k, v in ((k, by_hand(t, rules)) for k, t in texts.items()) if v}
    counts = {(r.path, r.rule_id): r.matches for r in match_counts(admit(corpus_of(texts)), rules).collect()}
    assert counts == {(k, n): c for k, t in texts.items() for n, c in Counter(m[0] for m in by_hand(t, rules)).items()}
    shown = show_matches(admit(corpus_of({"a": "xé é\n"})), [Rule("redact", "é")], safe=False).orderBy("start").collect()
    assert [(r.start, r.shown) for r in shown] == [(1, "é"), (4, "é")]


def test_a_text_with_every_mark_is_refused():
    texts = pa.array(["a", "".join(map(chr, engine._PRIVATE[:-1])), "b"])
    with pytest.raises(ValueError, match="private use"):
        engine.sliced(texts, texts, lambda p, t: pa.array([engine.marks(engine.raw_of(t)[0])[0]] * len(t)))
    some = engine.sliced(texts.slice(0, 1), texts.slice(0, 1), lambda p, t: pa.array([engine.marks(engine.raw_of(t)[0])[0]]))
    assert some.to_pylist() == [chr(engine._PRIVATE[0])]


def test_slices_are_handed_back_one_by_one(monkeypatch):
    """A worker lets go of a slice before it works on the next: no batch is put together again."""
    monkeypatch.setattr(engine, "_SLICE", 64)
    monkeypatch.setattr(engine.F, "arrow_udf", lambda run, returnType: run)
    seen = []

    def work(paths, texts):
        seen.append(len(texts))
        return pa.array(texts.to_pylist(), pa.string())

    texts = pa.array(["x" * 40, None, "y" * 40, "", "z" * 200, "w"])
    for run, batch in ((engine._udf(work, ""), (texts, texts)), (engine._udf(work, "", of_text=True), texts)):
        seen.clear()
        out = run(iter([batch, batch]))
        first = next(out)
        assert len(seen) == 1 and len(first) == seen[0] < len(texts)
        assert first.to_pylist() + [t for part in out for t in part.to_pylist()] == 2 * texts.to_pylist()
