"""Ordered regex rules that redact secrets and truncate bulky text."""

from __future__ import annotations

import warnings
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import extension
from ..functions.patterns import PatternError, to_java, to_re2
from ..sources.shipping import ship
from ._plan import settle
from .engine import compiles, rewriting

ship(__name__)

# The texts that stand in for a match, and for a stylesheet.
REDACTED = "██REDACTED██"
STYLE_CUT = "<style>…</style>"
SVG_CUT = "<svg>…</svg>"
CUT = "…"
STYLESHEET_TEXT = "/* CSS content simplified */"


@dataclass(frozen=True)
class Rule:
    """One rewrite: ``redact`` or ``truncate`` every match of ``pattern``.

    ``file_pattern`` limits it to paths it is found in. ``threshold`` is only
    printed in the replacement; the pattern alone decides what is cut.
    """

    type: str
    pattern: str
    file_pattern: str | None = None
    threshold: int | None = None

    @property
    def replacement(self) -> str:
        if self.type == "redact":
            return REDACTED
        if self.threshold is not None:
            return f'"...({self.threshold} chars truncated)..."'
        if "<style" in self.pattern:
            return STYLE_CUT
        if "<svg" in self.pattern:
            return SVG_CUT
        return CUT

    @property
    def label(self) -> str:
        return {"redact": "Redaction", "truncate": "Truncation"}.get(self.type, self.type)


# The default rules, in order.
DEFAULT_RULES = (
    Rule("redact", r"(?i)(password|api[_-]?key)\s*[:=]\s*\S+"),
    Rule("redact", r"\bAKIA[0-9A-Z]{16}\b"),
    Rule("redact", r"(?i)(secret|token)\s*[:=]\s*[A-Za-z0-9+/]{20,}={0,2}"),
    Rule("truncate", r"<style[^>]*>.*?</style>", r"\.html?$"),
    Rule("truncate", r"<svg[^>]*>.*?</svg>", r"\.(html?|xml|svg)$"),
    Rule("truncate", r'"[^"]{100,}"', r"\.json$", 50),
)

# Further secret shapes, opt-in.
EXTENDED_RULES = (
    Rule("redact", r"sk-[a-zA-Z0-9]{48}", r"\.(py|js|ts)$"),
    Rule("redact", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("redact", r"\bAKIA[0-9A-Z]{16}\b"),
    Rule("redact", r"\bghp_[A-Za-z0-9]{36}\b"),
    Rule("redact", r"\bxoxb-[0-9]{13}-[0-9]{13}-[A-Za-z0-9]{24}\b"),
    Rule("redact", r"(?i)(secret|key|token|password)\s*[:=]\s*[A-Za-z0-9+/]{20,}={0,2}"),
    Rule("redact", r"(?i)(key|secret|hash)\s*[:=]\s*[0-9a-f]{32,}"),
    Rule("redact", r"\bsk-[A-Za-z0-9]{48,}\b"),
    Rule(
        "redact",
        r"(?i)(token|key|secret)\s*[:=]\s*"
        r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
    ),
)


def rules_from_table(table: DataFrame) -> list[Rule]:
    """Rules from a table ``rule_id, type, pattern, file_pattern, threshold``, by rule_id.

    Rules are settings that go with every task, so the table is a small one.
    """
    rows = table.orderBy("rule_id").collect()
    return [Rule(r["type"], r["pattern"], r["file_pattern"], r["threshold"]) for r in rows]


@dataclass(frozen=True)
class Step:
    """A rule ready to run; ``error`` is set when a pattern is unusable."""

    rule_id: int
    rule: Rule
    re2: str | None = None
    file_re2: str | None = None
    file_java: str | None = None
    error: str | None = None


def _re2(pattern: str) -> str:
    translated = to_re2(pattern)
    refused = compiles(translated)
    if refused:
        raise PatternError(f"{refused}: {pattern}")
    return translated


def _java(regex, pattern: str) -> str:
    java = to_java(pattern)
    try:
        regex.compile(java)
    except Exception as e:
        cause = getattr(e, "java_exception", None)
        text = cause.getDescription() if cause is not None else str(e)
        raise PatternError(f"{text}: {pattern}") from None
    return java


def prepare(
    spark: SparkSession, rules: Iterable[Rule], on_bad_pattern: str = "raise"
) -> list[Step]:
    """Check and translate rules; numbered by their place in the list.

    Unknown rule types are skipped with a warning. A pattern that does not
    compile raises, or with ``on_bad_pattern='stub'`` turns the files it would
    have touched into error rows.
    """
    if on_bad_pattern not in ("raise", "stub"):
        raise ValueError("on_bad_pattern is 'raise' or 'stub'")
    steps = []
    regex = spark._jvm.java.util.regex.Pattern
    for rule_id, rule in enumerate(rules, 1):
        re2 = file_re2 = file_java = error = None
        try:
            if rule.file_pattern is not None:
                file_re2, file_java = _re2(rule.file_pattern), _java(regex, rule.file_pattern)
            if rule.type in ("redact", "truncate"):
                re2 = _re2(rule.pattern)
            else:
                warnings.warn(f"unknown rule type {rule.type!r} skipped", stacklevel=2)
        except PatternError as e:
            if on_bad_pattern == "raise":
                raise
            error = f"[error: Regex error: {e}]"
        if re2 or error:
            steps.append(Step(rule_id, rule, re2, file_re2, file_java, error))
    return steps


def is_stylesheet() -> Column:
    return F.lower(extension("path")) == "css"


def applicable_rules(files: DataFrame, rules: Iterable[Rule] = DEFAULT_RULES) -> DataFrame:
    """One row per file and rule whose file pattern is found in the path.

    A theta join of files and rules. Rules being literals, each path regex is
    compiled once per task and no join is planned.
    """
    on = [
        F.when(
            F.col("path").rlike(s.file_java) if s.file_java else F.lit(True),
            F.struct(F.lit(s.rule_id).alias("rule_id"), F.lit(s.rule.type).alias("type")),
        )
        for s in prepare(files.sparkSession, rules)
    ]
    hits = files.select("path", F.inline(F.array_compact(F.array(*on))))
    return hits


def _live() -> Column:
    """Rows that rules see: texts, but for stylesheets."""
    return (F.col("status") == "text") & ~F.coalesce(is_stylesheet(), F.lit(False))


def _named(step: Step) -> Column:
    return F.col("path").rlike(step.file_java) if step.file_java else F.lit(True)


def rewrite(
    files: DataFrame,
    rules: Iterable[Rule] = DEFAULT_RULES,
    *,
    counts: bool = False,
    on_bad_pattern: str = "raise",
) -> DataFrame:
    """Run the rules over ``content`` of text files, in order.

    Stylesheets skip the rules and become a constant. With ``counts``, column
    ``rule_counts`` holds ``{rule_id, type, matches}`` of every rule that hit.
    No shuffle: each row is rewritten where it is.
    """
    done = rewritten(files, rules, counts=counts, on_bad_pattern=on_bad_pattern)
    return settle(done, "status", "content", *(["rule_counts"] if counts else []))


def rewritten(
    files: DataFrame,
    rules: Iterable[Rule] = DEFAULT_RULES,
    *,
    counts: bool = False,
    on_bad_pattern: str = "raise",
) -> DataFrame:
    """:func:`rewrite` without moving rows, which keeps the order of sorted ones.

    All rules run in one pass over Arrow batches; a text that no rule changes does not come back.
    Rows that an unusable rule would touch become errors and have no counts.
    """
    kept = files.columns
    steps = prepare(files.sparkSession, rules, on_bad_pattern)
    bad = [F.when(_live() & _named(s), F.lit(s.error)) for s in steps if s.error]
    error = F.coalesce(*bad) if bad else F.lit(None).cast("string")
    done = files.withColumn("__error", error)
    usable = [s for s in steps if not s.error]
    text = F.when(_live() & F.col("__error").isNull(), F.col("content"))
    done = done.withColumn("__done", rewriting(usable, counts)(F.col("path"), text))
    blank = (F.col("status") == "text") & F.coalesce(is_stylesheet(), F.lit(False))
    content = F.when(blank, F.lit(STYLESHEET_TEXT)).otherwise(
        F.coalesce("__error", F.col("__done.content"), "content")
    )
    status = F.when(F.col("__error").isNotNull(), "error").otherwise(F.col("status"))
    changed = {"status": status.alias("status"), "content": content.alias("content")}
    columns = [changed.get(c, F.col(c)) for c in kept]
    return done.select(*columns, *([F.col("__done.rule_counts").alias("rule_counts")] if counts else []))


def match_counts(files: DataFrame, rules: Iterable[Rule] = DEFAULT_RULES) -> DataFrame:
    """One row per file and rule that hit: number of matches when its turn came."""
    counted = rewrite(files.select("path", "status", "content"), rules, counts=True)
    return counted.select("path", F.inline("rule_counts"))


def redaction_totals(files: DataFrame, rules: Iterable[Rule] = DEFAULT_RULES) -> DataFrame:
    """Redactions per file, for files that had any; truncations do not count."""
    counted = rewrite(files.select("path", "status", "content"), rules, counts=True)
    redactions = F.aggregate(
        F.filter("rule_counts", lambda c: c["type"] == "redact"),
        F.lit(0).cast("bigint"),
        lambda n, c: n + c["matches"],
    )
    totals = counted.select("path", redactions.alias("redactions")).where("redactions > 0")
    message = F.format_string(
        "Filter summary: Applied %d total redaction(s) to %s", F.col("redactions"), F.col("path")
    )
    return totals.withColumn("message", message)
