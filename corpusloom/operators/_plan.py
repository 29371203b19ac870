"""Plan shaping shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, *computed: str) -> DataFrame:
    """Compute these columns once, here.

    A filter above a projection is pushed below it with the expressions copied
    in. For a column made by a stack of rules that copies the text expression
    twice per rule, and the plan doubles with each. A one-row generator stops
    filters on the computed columns, and only on those: filters on the columns
    that pass through still reach the scan.
    """
    passed = [c for c in df.columns if c not in computed]
    row = F.struct(*(F.col(c).alias(c) for c in computed))
    out = df.select(*passed, F.inline(F.array(row)))
    return out.select(*df.columns)
