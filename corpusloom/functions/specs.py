"""Source specifications: ``url[@ref][#sub]`` or ``git@host:repo[@ref][:sub]``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _after(s: Column, mark: str) -> Column:
    """Text after the first mark; null when there is none."""
    at = F.instr(s, mark)
    return F.when(at > 0, F.substring(s, at + 1, F.length(s)))


def _before(s: Column, mark: str) -> Column:
    return F.substring_index(s, mark, 1)


def _cut_last(s: Column, mark: str) -> tuple[Column, Column]:
    """(left, right) around the last mark; right is null when there is none."""
    tail = F.substring_index(s, mark, -1)
    has = F.instr(s, mark) > 0
    left = F.when(has, F.substring(s, F.lit(1), F.length(s) - F.length(tail) - 1)).otherwise(s)
    return left, F.when(has, tail)


def source_spec(spec: Column | str) -> Column:
    """Struct ``url, subpath, reference`` of a source specification."""
    s = F.col(spec) if isinstance(spec, str) else spec
    shell_form = (
        F.lower(s).startswith("git@") & (F.instr(s, ":") > 0) & ~s.startswith("git@http")
    )

    host, rest = _before(s, ":"), _after(s, ":")
    ref_part = _after(rest, "@")
    shell = F.struct(
        F.when(ref_part.isNotNull(), F.concat(host, F.lit(":"), _before(rest, "@")))
        .otherwise(F.concat(host, F.lit(":"), _before(rest, ":")))
        .alias("url"),
        F.when(ref_part.isNotNull(), _after(ref_part, ":"))
        .otherwise(_after(rest, ":"))
        .alias("subpath"),
        _before(ref_part, ":").alias("reference"),
    )

    no_sub, subpath = _cut_last(s, "#")
    url, reference = _cut_last(no_sub, "@")
    plain = F.struct(url.alias("url"), subpath.alias("subpath"), reference.alias("reference"))
    return F.when(shell_form, shell).otherwise(plain)


def is_remote(url: Column | str) -> Column:
    """True for a parsed url with a remote scheme or a ``.git`` ending."""
    url = F.col(url) if isinstance(url, str) else url
    low = F.lower(url)
    remote = url.endswith(".git")
    for scheme in ("https://", "http://", "git@", "ssh://"):
        remote = remote | low.startswith(scheme)
    return remote
