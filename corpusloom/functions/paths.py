"""Path expressions. A path is a string of components joined by ``/``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# NUL sorts below every byte a path may hold, so swapping it in for the
# separator makes plain string order equal component-by-component order.
_LOWEST = "\u0000"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_path(path: Column | str) -> Column:
    """Every backslash becomes a forward slash."""
    return F.translate(_col(path), "\\", "/")


def file_name(path: Column | str) -> Column:
    """Last component."""
    return F.substring_index(_col(path), "/", -1)


def extension(path: Column | str) -> Column:
    """Text after the last dot of the file name; '' for ``.png`` and ``Makefile``."""
    return F.regexp_extract(file_name(path), r"(?s)^.+\.([^.]*)\z", 1)


def relative_to(path: Column | str, base: str) -> Column:
    """Strip ``base`` by whole components; a path outside it is left alone."""
    path = _col(path)
    base = base.rstrip("/") if base != "/" else ""
    if not base:
        return path
    return (
        F.when(path == base, F.lit(""))
        .when(path.startswith(base + "/"), F.substr(path, F.lit(len(base) + 2)))
        .otherwise(path)
    )


def path_key(path: Column | str) -> Column:
    """Sort key for file order: compares component by component."""
    # Not translate(), which takes NUL to mean deletion.
    return F.replace(_col(path), F.lit("/"), F.lit(_LOWEST))


def depth(path: Column | str) -> Column:
    """Number of components; a leading ``.`` and the root each count as one."""
    path = _col(path)
    return F.when(path == "/", 1).otherwise(F.size(F.split(path, "/")))


def ancestors(path: Column | str) -> Column:
    """Array of the directories above a path, without '' and ``.``."""
    parts = F.split(_col(path), "/")
    above = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1),
        lambda k: F.concat_ws("/", F.slice(parts, F.lit(1), k)),
    )
    above = F.transform(above, lambda p: F.when(p == "", F.lit("/")).otherwise(p))
    rooted = _col(path).startswith("/")
    kept = F.filter(above, lambda p: (p != ".") & ((p != "/") | rooted))
    return F.when(F.size(parts) > 1, kept).otherwise(F.array().cast("array<string>"))


def parent(path: Column | str) -> Column:
    """Directory holding the path, '' at the top."""
    path = _col(path)
    return F.left(path, F.char_length(path) - F.char_length(file_name(path)) - 1)


def under_directory(path: Column | str, name: str) -> Column:
    """True when some directory above the file has exactly this name."""
    parts = F.split(_col(path), "/")
    return F.array_contains(F.slice(parts, F.lit(1), F.size(parts) - 1), name)
