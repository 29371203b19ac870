"""Sizes: byte lengths, size literals and the token estimate."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNIT = {"": 1, "K": 1 << 10, "M": 1 << 20, "G": 1 << 30}
_LITERAL = r"(?Ui)\A\s*(\+?[0-9]+)([KMG]?)\s*\z"


def byte_length(text: Column | str) -> Column:
    return F.octet_length(text).cast("bigint")


def token_estimate(n_bytes: Column | str) -> Column:
    """ceil(n / 4 * 1.3) in whole numbers, from a number of bytes."""
    n = F.col(n_bytes) if isinstance(n_bytes, str) else n_bytes
    return F.call_function("div", n.cast("bigint") * 13 + 39, F.lit(40))


def parse_size(literal: Column | str, strict: bool = False) -> Column:
    """Bytes of a size literal (``4M``); null when malformed, an error when strict."""
    lit = F.col(literal) if isinstance(literal, str) else literal
    number = F.regexp_extract(lit, _LITERAL, 1).try_cast("decimal(38,0)")
    unit = F.upper(F.regexp_extract(lit, _LITERAL, 2))
    scale = F.lit(1)
    for name in ("K", "M", "G"):
        scale = F.when(unit == name, _UNIT[name]).otherwise(scale)
    value = F.try_multiply(number, scale.cast("decimal(11,0)")).try_cast("bigint")
    if not strict:
        return value
    bad = F.raise_error(F.concat(F.lit("Invalid size format: "), lit)).cast("bigint")
    return F.when(value.isNull() & lit.isNotNull(), bad).otherwise(value)


def size_bytes(literal: str | int) -> int:
    """Driver-side form of :func:`parse_size` for options."""
    if isinstance(literal, int):
        return literal
    found = re.fullmatch(r"\s*\+?([0-9]+)([KMGkmg]?)\s*", literal)
    if not found:
        raise ValueError(f"Invalid size format: {literal!r}")
    return int(found[1]) * _UNIT[found[2].upper()]
