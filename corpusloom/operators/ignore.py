"""Ignore rules: which files a set of gitignore-style rules leaves out.

Follows the public gitignore documentation: the last matching rule of the
nearest rule file decides, ``!`` takes a path back in, and nothing below an
ignored directory can be taken back.
"""

from __future__ import annotations

import logging

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, file_name, parent, under_directory
from ..sources.shipping import ship
from ..sources.workspace import workspace
from ._plan import settle
from .skew import SALTS, salt, spread_join

ship(__name__)

_log = logging.getLogger(__name__)

# Rule files by name, and how strong each kind is.
IGNORE_FILE = ".ignore"
GIT_IGNORE_FILE = ".gitignore"
GIT_EXCLUDE_FILE = ".git/info/exclude"
KINDS = {"ignore": 4, "gitignore": 3, "exclude": 2, "global": 1}

#: Characters up to which the end or beginning of a name is looked up by its length.
LONGEST_KEY = 255
_SEP = "\u0000"


def drop_vcs(files: DataFrame) -> DataFrame:
    """Leave out everything below a directory named ``.git``; a file of that name stays."""
    return files.where(~under_directory("path", ".git"))


def _class(glob: str, at: int) -> tuple[str, int] | None:
    """The character class that opens at ``at`` as Java's, and where it ends; None if it isn't one."""
    i, items, negated = at + 1, [], False
    if glob[i : i + 1] in ("!", "^"):
        negated, i = True, i + 1
    first = i
    while i < len(glob) and (glob[i] != "]" or i == first):
        if glob[i] == "\\":
            i += 1
            if i == len(glob):
                return None
        low, i = glob[i], i + 1
        if glob[i : i + 1] == "-" and glob[i + 1 : i + 2] not in ("]", ""):
            i += 1 + (glob[i + 1] == "\\")
            if i >= len(glob) or glob[i] < low:
                return None
            items.append(f"{_literal(low)}-{_literal(glob[i])}")
            i += 1
        else:
            items.append(_literal(low))
    if i >= len(glob):
        return None
    inside = "".join(items)
    return (f"[^/{inside}]" if negated else f"(?!/)[{inside}]"), i + 1


def _literal(char: str) -> str:
    return char if char.isalnum() or not char.isascii() or char in "/_" else "\\" + char


def glob_text(glob: str) -> str | None:
    """Java's regular expression for a path relative to the rule's directory; None if the glob is no glob."""
    anchored = "/" in glob.rstrip("/")
    rest, out = glob.removeprefix("/"), []
    while rest.startswith("**/"):
        out, rest = ["(?:.*/)?"], rest[3:]
    i = 0
    while i < len(rest):
        char = rest[i]
        if rest.startswith("/**/", i):
            out.append("/(?:.*/)?")
            i += 4
            while rest.startswith("**/", i):
                i += 3
        elif rest[i:] == "/**":
            out.append("/.+")
            i += 3
        elif char == "*":
            out.append("[^/]*")
            while rest[i : i + 1] == "*":
                i += 1
        elif char == "[":
            found = _class(rest, i)
            if found is None:
                return None
            out.append(found[0])
            i = found[1]
        elif char == "\\":
            if i + 1 == len(rest):
                return None
            out.append(_literal(rest[i + 1]))
            i += 2
        else:
            out.append("[^/]" if char == "?" else _literal(char))
            i += 1
    return rf"(?s)\A{'' if anchored else '(?:.*/)?'}{''.join(out)}\z"


def _plain(glob: str) -> str | None:
    """What a glob without wildcards stands for; None if it has some."""
    out, i = [], 0
    while i < len(glob):
        if glob[i] in "*?[":
            return None
        i += glob[i] == "\\"
        out.append(glob[i : i + 1])
        i += 1
    return "".join(out)


def glob_form(glob: str) -> tuple[str, str]:
    """How nodes that a glob matches are found by equal keys, and the key's text.

    ``name`` (the last component is), ``end`` and ``begin`` (it ends or begins with) and ``path`` (the
    path below the rule's directory is) decide alone; ``under`` (the directory that all matches lie
    below) and ``glob`` (any node) leave it to the regular expression.
    """
    anchored, rest = "/" in glob.rstrip("/"), glob.removeprefix("/")
    while rest.startswith("**/"):
        rest = rest[3:]
        anchored = "/" in rest
    if not anchored:
        open_end, open_start = rest.rstrip("*"), rest.lstrip("*")
        tries = [("name", rest), ("end", open_start), ("begin", open_end)]
        cut = open_end != rest and not (len(open_end) - len(open_end.rstrip("\\"))) % 2
        for form, text in tries[: 3 if cut else 2]:
            found = _plain(text)
            if found and len(found) <= LONGEST_KEY:
                return form, found
        return "glob", ""
    if glob.startswith("**/"):
        return "glob", ""
    whole = _plain(rest)
    if whole is not None:
        return "path", whole
    head = ""
    for part in rest.split("/")[:-1]:
        found = _plain(part)
        if not found:
            break
        head += f"/{found}" if head else found
    return ("under", head) if head else ("glob", "")


def _globs(globs: pa.Array) -> pa.Array:
    rows = []
    for glob in globs.to_pylist():
        regex = None if glob is None else glob_text(glob)
        if glob is not None and regex is None:
            _log.warning("ignore rule left out, it is no glob: %s", glob)
        rows.append((regex, *(("", "") if regex is None else glob_form(glob))))
    columns = zip(*rows) if rows else ([], [], [])
    return pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], ["regex", "form", "needle"])


def read_globs(glob: Column) -> Column:
    """:func:`glob_text` and :func:`glob_form` of a column of globs."""
    return F.arrow_udf(_globs, returnType="struct<regex: string, form: string, needle: string>")(glob)


def parse_rules(lines: DataFrame) -> DataFrame:
    """Rules from lines ``owner, kind, line_no, line``; blank lines and comments drop out.

    ``owner`` is the directory the rule file lies in, '' at the top. Lines whose glob is broken
    (a class that isn't closed, a range that runs backwards, a backslash at the end) are left out
    with a warning in the executor's log.
    """
    text = F.regexp_replace("line", r"\r\z", "")
    text = F.regexp_replace(text, r"(?<!\\) +\z", "")
    rules = lines.withColumn("glob", text).where("glob <> '' and not startswith(glob, '#')")
    negated = F.startswith("glob", F.lit("!"))
    body = F.when(negated, F.substr("glob", F.lit(2))).otherwise(F.col("glob"))
    rules = rules.withColumn("negated", negated).withColumn("glob", body)
    dir_only = F.endswith("glob", F.lit("/"))
    rules = rules.withColumn("dir_only", dir_only).withColumn(
        "glob", F.regexp_replace("glob", r"/+\z", "")
    )
    rank = F.lit(0)
    for kind, strength in KINDS.items():
        rank = F.when(F.col("kind") == kind, strength).otherwise(rank)
    found = rules.where("glob <> ''").select(
        "owner",
        rank.alias("strength"),
        F.col("line_no").cast("bigint").alias("line_no"),
        "negated",
        "dir_only",
        read_globs(F.col("glob")).alias("glob"),
    )
    return settle(found, "glob").select("*", "glob.*").drop("glob").where("regex is not null")


def rules_in_corpus(files: DataFrame) -> DataFrame:
    """Rules of the ignore files that lie among the files (``path, content``)."""
    name = file_name("path")
    kind = (
        F.when(name == IGNORE_FILE, "ignore")
        .when(name == GIT_IGNORE_FILE, "gitignore")
        .when((F.col("path") == GIT_EXCLUDE_FILE) | F.endswith("path", F.lit("/" + GIT_EXCLUDE_FILE)), "exclude")
    )
    owner = F.when(kind == "exclude", F.regexp_replace("path", r"/?\.git/info/exclude\z", ""))
    found = files.where(kind.isNotNull()).select(
        owner_or_parent(owner).alias("owner"), kind.alias("kind"), "content"
    )
    return parse_rules(
        found.select(
            "owner", "kind", F.posexplode(F.split("content", "\n", -1)).alias("line_no", "line")
        )
    )


def owner_or_parent(owner: Column) -> Column:
    return F.coalesce(owner, parent("path"))


def ignored_files(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``ignored`` to the files (take paths, not texts, through here).

    Every directory points to the directories at and above it that own rules: a short list of names,
    never their rules. Directories are judged first, each once; below an ignored one nothing is asked
    any more. Rules are met by equal keys (a name, the end or beginning of one, a path), so a rule file
    of any length costs a node a few look-ups; only globs with wildcards elsewhere are tried one by one,
    those with a directory in front only below it. Joins go over a spread key, so a directory with most
    of the files in it, or a rule that all of them meet, is shared by many tasks.
    """
    # Written, so that globs are read once and Spark knows the size of what it joins with.
    rules = _written(rules.where("owner is not null"))
    probes = _probes(rules)
    lookup = _keyed(rules)
    dirs = _written(_directories(files, rules))
    nodes = dirs.where("dir <> ''").select(F.col("dir").alias("path"), _owners_of_parent().alias("__owners"))
    gone = _below_ignored(dirs, _judged(nodes, lookup, probes))
    known = dirs.join(gone, "dir", "left").select(
        F.col("dir").alias("__dir"), F.col("owners").alias("__owners"), F.coalesce("gone", F.lit(False)).alias("__gone")
    )
    met = spread_join(files.withColumn("__dir", parent("path")), known, ["__dir"], "left")
    # Each file has one key that no rule has, by which its copies are counted.
    keys = F.concat(F.array(F.lit("")), F.coalesce(F.when(~F.col("__gone"), probes), F.array().cast("array<string>")))
    asked = met.select(*files.columns, "__gone", F.explode(keys).alias("probe"))
    tried = spread_join(asked, lookup.where("not dir_only"), ["probe"], "left")
    # A file's own key and the rules that match it go on. They are dealt out before they are gathered, or
    # a task would hold what all its files ask for; copies of a file part by the salt.
    own = F.col("probe") == ""
    told = tried.where(own | _matches()).select(*files.columns, "__gone", own.alias("__own"), "negated", "order")
    told = told.withColumn("__salt", salt(["negated", "order"], SALTS)).repartition(*files.columns, "__salt")
    judged = told.groupBy(*files.columns, "__gone").agg(
        F.count_if("__own").alias("__n"), F.max_by("negated", "order").alias("__back")
    )
    ignored = F.coalesce(F.col("__gone") | F.coalesce(~F.col("__back"), F.lit(False)), F.lit(False))
    each = judged.select(*files.columns, ignored.alias("ignored"), F.explode(F.array_repeat(F.lit(0), F.col("__n").cast("int"))))
    return each.drop("col")


def _matches() -> Column:
    """Whether a node meets a rule that it shares a key with."""
    inside = F.when(F.col("owner") == "", F.col("path")).otherwise(F.substr("path", F.length("owner") + 2))
    return F.col("owner").isNotNull() & (F.col("regex").isNull() | F.regexp_like(inside, F.col("regex")))


def _written(rows: DataFrame) -> DataFrame:
    folder = workspace(rows.sparkSession)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def drop_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    return ignored_files(files, rules).where(~F.col("ignored")).drop("ignored")


def _directories(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``dir, owners``: every directory at or below one that owns rules, and those owners."""
    above = F.concat(F.array(F.lit("")), ancestors("dir"), F.array("dir"))
    held = files.select(parent("path").alias("dir")).where("dir is not null").distinct()
    dirs = held.select(F.explode(F.array_distinct(above)).alias("dir"))
    reached = dirs.select("dir", F.explode(F.array_distinct(above)).alias("owner"))
    met = spread_join(reached, rules.select("owner").distinct(), ["owner"])
    return met.groupBy("dir").agg(F.array_sort(F.collect_set("owner")).alias("owners"))


def _owners_of_parent() -> Column:
    """A directory's own rules are about what lies in it, not about itself."""
    return F.filter("owners", lambda o: o != F.col("dir"))


def _below_ignored(dirs: DataFrame, judged: DataFrame) -> DataFrame:
    """``dir, gone`` for directories that are ignored or lie in one that is."""
    lost = judged.where("ignored").select(F.col("path").alias("node"))
    nodes = dirs.select("dir", F.explode(F.concat(ancestors("dir"), F.array("dir"))).alias("node"))
    return nodes.join(lost, "node", "left_semi").select("dir").distinct().withColumn("gone", F.lit(True))


def _keyed(rules: DataFrame) -> DataFrame:
    """Rules with the key ``probe`` that nodes they may match have, too."""
    below = F.when(F.col("owner") == "", F.col("needle")).otherwise(F.concat("owner", F.lit("/"), F.col("needle")))
    in_owner = F.concat("form", F.lit(_SEP), "owner", F.lit(_SEP), "needle")
    probe = F.when(F.col("form").isin("path", "under"), F.concat("form", F.lit(_SEP), below)).otherwise(in_owner)
    reach = F.when(F.col("owner") == "", 0).otherwise(F.length("owner") + 1)
    regex = F.when(F.col("form").isin("under", "glob"), F.col("regex"))
    order = F.struct("strength", reach.alias("reach"), "line_no", "negated")
    return rules.select(probe.alias("probe"), "owner", order.alias("order"), "negated", "dir_only", regex.alias("regex"))


def _probes(rules: DataFrame) -> Column:
    """The keys of a node (``path`` and ``__owners``) under which rules may be found, of forms that there are.

    What is collected is form and length of the keys: at most two times ``LONGEST_KEY`` and four.
    """
    size = F.when(F.col("form").isin("end", "begin"), F.length("needle")).otherwise(0)
    kinds = {(r["form"], r["size"]) for r in rules.select("form", size.alias("size")).distinct().collect()}
    forms, name = {form for form, _ in kinds}, file_name("path")
    cuts = {form: sorted(n for f, n in kinds if f == form) for form in ("end", "begin")}

    def of_owner(owner: Column) -> Column:
        key = lambda form, text: F.concat(F.lit(form + _SEP), owner, F.lit(_SEP), text)
        found = [key("name", name)] if "name" in forms else []
        found += [F.when(F.length(name) >= n, key("end", F.right(name, F.lit(n)))) for n in cuts["end"]]
        found += [F.when(F.length(name) >= n, key("begin", F.left(name, F.lit(n)))) for n in cuts["begin"]]
        found += [key("glob", F.lit(""))] if "glob" in forms else []
        return F.array(*found).cast("array<string>")

    keys = [F.flatten(F.transform("__owners", of_owner))]
    if "path" in forms:
        keys.append(F.array(F.concat(F.lit("path" + _SEP), "path")))
    if "under" in forms:
        keys.append(F.transform(ancestors("path"), lambda d: F.concat(F.lit("under" + _SEP), d)))
    return F.array_compact(F.concat(*keys))


def _judged(dirs: DataFrame, lookup: DataFrame, probes: Column) -> DataFrame:
    """``path, ignored`` of the directories (``path, __owners``) that some rule matches: the strongest one decides."""
    met = spread_join(dirs.select("path", F.explode(probes).alias("probe")), lookup, ["probe"])
    return met.where(_matches()).groupBy("path").agg((~F.max_by("negated", "order")).alias("ignored"))


def in_repositories(rules: DataFrame, repositories: DataFrame) -> DataFrame:
    """Rules without those of version control that lie in no repository (``owner``: its top directory)."""
    above = F.concat(F.array(F.lit("")), ancestors("owner"), F.array("owner"))
    tops = repositories.select(F.col("owner").alias("__top")).distinct()
    placed = rules.where(F.col("strength") != KINDS["ignore"]).withColumn("__top", F.explode(F.array_distinct(above)))
    own = placed.join(tops, "__top", "left_semi").drop("__top").distinct()
    return rules.where(F.col("strength") == KINDS["ignore"]).unionByName(own)
