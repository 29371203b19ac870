"""Match table: what each rule found, by line and byte span."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sizes import byte_length
from .engine import finding, lining
from .rules import DEFAULT_RULES, Rule, _live, match_counts, prepare

_SHOWN_BYTES, _SHOWN_CUT = 100, 97


def line_table(files: DataFrame) -> DataFrame:
    """Lines of each file: number from 1, byte offset of the line, its length, its text.

    A line feed at the end starts no further line, and an empty text has none. Offsets are worked
    out where the text is, a batch of texts at a time, so no text is shuffled to be numbered.
    """
    lines = files.select("path", lining()(F.col("content")).alias("found"))
    each = lines.select("path", F.posexplode("found.lines").alias("at", "line"))
    number = (F.col("at") + 1).cast("bigint").alias("line_no")
    return each.select("path", number, "line.start", "line.len", "line.line")


def _matches(files: DataFrame, rules: Iterable[Rule], safe: bool) -> DataFrame:
    """``path, matches``: files with a match, all matches of the file in one array by rule and place."""
    steps = prepare(files.sparkSession, rules)
    if not steps:
        raise ValueError("no rule to look for")
    found = finding(steps, safe)(F.col("path"), F.when(_live(), F.col("content")))
    rows = files.select("path", found.alias("found"))
    return rows.select("path", F.col("found.matches").alias("matches")).where(F.size("matches") > 0)


def match_table(
    files: DataFrame, rules: Iterable[Rule] = DEFAULT_RULES, *, safe: bool = True
) -> DataFrame:
    """Every match of every rule, on the text as it stood before that rule.

    One pass over the text and no shuffle: positions are worked out where the text is. With
    ``safe`` the table carries no matched text at all. Matches may be empty; those that lie inside
    no line (at a line feed, or behind the last character) are flagged ``at_break``.
    """
    table = _matches(files, rules, safe).select("path", F.inline("matches"))
    return table.drop("text") if safe else table


def show_matches(
    files: DataFrame, rules: Iterable[Rule] = DEFAULT_RULES, *, safe: bool = True
) -> DataFrame:
    """The match log: ``line_no, shown, message`` per match.

    Safe mode shows positions; otherwise the text, cut when over 100 bytes. A
    match that starts at a line break belongs to no line and is left out.
    """
    rules = list(rules)
    table = match_table(files, rules, safe=safe).where(~F.col("at_break"))
    shown = _shown(F.col, safe)
    label = F.when(F.col("type") == "redact", "Redaction").otherwise("Truncation")
    message = F.format_string("  %s match at line %d: '%s'", label, F.col("line_no"), F.col("shown"))
    return table.withColumn("shown", shown).select(
        "path", "rule_id", "type", "line_no", "start", "len", "shown", message.alias("message")
    )


def _shown(field, safe: bool) -> Column:
    """What the log shows of a match whose fields ``field`` gives: its place, or its text.

    Long texts are cut behind the last character that ends within the first 97 bytes.
    """
    if safe:
        return F.format_string(
            "[characters %d-%d]", field("line_offset") + 1, field("line_offset") + field("len")
        )
    fits = lambda n: byte_length(F.left(field("text"), n)) <= _SHOWN_CUT
    sizes = F.sequence(F.lit(_SHOWN_CUT // 4), F.lit(_SHOWN_CUT))
    cut = F.concat(F.left(field("text"), F.array_max(F.filter(sizes, fits))), F.lit("..."))
    return F.when(field("len") > _SHOWN_BYTES, cut).otherwise(field("text"))


def match_headers(files: DataFrame, rules: Iterable[Rule] = DEFAULT_RULES) -> DataFrame:
    """Head line of the log for every file and rule that hit."""
    rules = list(rules)
    counts = match_counts(files, rules)
    patterns = F.array(*(F.lit(r.pattern) for r in rules))
    labels = F.array(*(F.lit(r.label) for r in rules))
    message = F.format_string(
        "Filter applied: %s pattern '%s' matched %d time(s) in %s",
        F.element_at(labels, F.col("rule_id")),
        F.element_at(patterns, F.col("rule_id")),
        F.col("matches"),
        F.col("path"),
    )
    return counts.select("path", "rule_id", "matches", message.alias("message"))


def matches_by_line(
    files: DataFrame, rules: Iterable[Rule] = DEFAULT_RULES, *, safe: bool = True
) -> DataFrame:
    """Matches of a line together, in order, without moving any row.

    A row's matches stand by rule and place, so those of a line follow each other: each run begins
    where rule or line differ from the match before, and ends where the next one begins.
    """
    held = _matches(files, list(rules), safe)
    held = held.withColumn("matches", F.filter("matches", lambda m: ~m["at_break"])).where(F.size("matches") > 0)

    def differs(m: Column, i: Column) -> Column:
        before = F.get("matches", i - 1)
        return (i == 0) | (before["rule_id"] != m["rule_id"]) | (before["line_no"] != m["line_no"])

    places = F.transform("matches", lambda m, i: F.when(differs(m, i), i))
    runs = held.withColumn("begins", F.array_compact(places))
    size = lambda b, j: F.coalesce(F.get("begins", j + 1), F.size("matches")) - b
    group = F.transform("begins", lambda b, j: F.slice("matches", b + 1, size(b, j)))
    each = runs.select("path", F.explode(group).alias("m"))
    return each.select(
        "path",
        F.col("m")[0]["rule_id"].alias("rule_id"),
        F.col("m")[0]["line_no"].alias("line_no"),
        F.size("m").cast("bigint").alias("matches"),
        F.transform("m", lambda x: _shown(lambda name: x[name], safe)).alias("shown"),
    )
