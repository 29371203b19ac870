"""Small tables with the awkward rows that every operator must stand."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from support import CLASHING, prose  # noqa: E402


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text[, lang, source]) with columns of clashing names."""

    def build(rows):
        full = [(*r, *(None,) * (4 - len(r))) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string")
        for name in CLASHING:
            df = df.selectExpr("*", f"'clash' AS {name}")
        return df.repartition(3)

    return build


@pytest.fixture(scope="session")
def awkward():
    """Rows with a null id or text, empty and blank texts, ties, repeats and one long text."""
    base = prose(1, 120)
    changed = base.split()
    changed[60] = "other"
    return [
        (1, base, "en", "a"),
        (2, base, "en", "b"),
        (2, base, "en", "b"),
        (3, " ".join(changed), None, None),
        (4, None, "en", "a"),
        (5, "", "de", "a"),
        (6, " \t\n\x0b\r ", "de", None),
        (7, "one", "en", "c"),
        (8, "One", "en", "c"),
        (None, base, "en", "c"),
        (None, None, None, None),
        (9, prose(2, 30_000, 5000), "en", "a"),
        (10, "É ü ¿ñ? " * 20 + prose(3, 70), "es", "b"),
        (11, prose(4, 60) + " " + base, "en", "a"),
    ]
