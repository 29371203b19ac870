"""Snapshots of a corpus: comparing two, choosing part of one, naming one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, parent
from ..sources.workspace import workspace
from .skew import spread_join


class SubpathNotFound(FileNotFoundError):
    """The snapshot has nothing at the subpath."""


def compare_snapshots(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path, change`` with change in added, removed, changed, same.

    Texts are reduced to a length and a SHA-256 where they are, written with their paths. Every
    directory gets a digest of all that lies below it, made of its files' digests like a hash tree;
    files below a directory that has one digest on both sides are the same without being looked
    up, and only what lies in the others is joined by path. A path is expected once on each side.
    """
    old, new = _digests(before), _digests(after)
    equal = _equal_directories(old, new)
    kept = lambda df: spread_join(df.withColumn("__dir", parent("path")), equal, ["__dir"], "left_anti")
    unchanged = spread_join(new.withColumn("__dir", parent("path")), equal, ["__dir"], "left_semi")
    sides = [kept(df).select("path", F.struct("size", "sha256").alias(side)) for df, side in ((old, "old"), (new, "new"))]
    both = sides[0].join(sides[1], "path", "full_outer")
    change = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "removed")
        .when(F.col("old") == F.col("new"), "same")
        .otherwise("changed")
    )
    return both.select("path", change.alias("change")).unionByName(unchanged.select("path", F.lit("same").alias("change")))


def _digests(files: DataFrame) -> DataFrame:
    """``path, size, sha256``, written: texts are hashed once, whatever reads the digests."""
    digest = F.sha2(F.col("content").cast("binary"), 256)
    folder = workspace(files.sparkSession)
    rows = files.select("path", F.octet_length("content").alias("size"), digest.alias("sha256"))
    rows.write.parquet(folder)
    return files.sparkSession.read.schema(rows.schema).parquet(folder)


def directory_digests(files: DataFrame) -> DataFrame:
    """``dir, files, digest`` of every directory over ``path, size, sha256``, the top one being ''.

    The digest is the exclusive or of SHA-256 values of path, length and content of all files below, in
    four longs: it does not depend on their order, so it is added up within each task before the
    shuffle, a row per task and directory.
    """
    whole = F.sha2(F.concat_ws("/", F.col("path"), F.col("size").cast("string"), "sha256").cast("binary"), 256)
    word = lambda i: F.conv(F.substr("__h", F.lit(1 + 16 * i), F.lit(16)), 16, -10).cast("bigint")
    words = [f"__w{i}" for i in range(4)]
    hashed = files.select("path", whole.alias("__h")).select("path", *(word(i).alias(w) for i, w in enumerate(words)))
    # Files fold into their own directory first, and only directories are taken apart into ancestors.
    own = hashed.groupBy(parent("path").alias("__in")).agg(F.count("*").alias("files"), *(F.bit_xor(w).alias(w) for w in words))
    above = F.array_distinct(F.concat(F.array(F.lit("")), ancestors("__in"), F.array("__in")))
    sums = own.select(F.explode(above).alias("dir"), "files", *words).groupBy("dir")
    total = sums.agg(F.sum("files").alias("files"), *(F.bit_xor(w).alias(w) for w in words))
    return total.select("dir", "files", F.struct(*words).alias("digest"))


def _equal_directories(old: DataFrame, new: DataFrame) -> DataFrame:
    """``__dir`` of the directories whose own files are the same on both sides, as they or one above are."""
    left = directory_digests(old)
    right = directory_digests(new).withColumnsRenamed({"files": "__files", "digest": "__digest"})
    same = (F.col("files") == F.col("__files")) & (F.col("digest") == F.col("__digest"))
    return left.join(right, "dir").where(same).select(F.col("dir").alias("__dir"))


def select_subpath(files: DataFrame, subpath: str, *, check: bool = True) -> DataFrame:
    """Files at or under a path. Raises if there is none, unless ``check`` is off."""
    sub = subpath.strip("/")
    if not sub:
        return files
    chosen = files.where((F.col("path") == sub) | F.col("path").startswith(sub + "/"))
    if check and chosen.select("path").isEmpty():
        raise SubpathNotFound(f"Subpath '{subpath}' not found in repository")
    return chosen


def resolve_references(requests: DataFrame, refs: DataFrame, defaults: DataFrame) -> DataFrame:
    """Add ``commit`` to ``repo, reference`` requests.

    ``refs`` has ``repo, name, commit`` with a row per commit under its own id
    and per full reference name; where it has a column ``target`` too, rows whose target is not null
    are symbolic and stand for the reference of that name. ``defaults`` has ``repo, commit``. The id wins,
    then branch, tag, remote branch; a name starting with ``refs/`` is used as
    is. A reference that is missing, or not found, gives the default.

    Each distinct request is looked up once, so one asked for by most rows
    costs no more than any other, and the answer goes back over a spread key.
    """
    if "target" in refs.columns:
        refs = follow_references(refs)
    wanted = requests.select("repo", "reference").where("reference is not null").distinct()
    name = F.col("reference")
    names = F.when(F.startswith("reference", F.lit("refs/")), F.array(name)).otherwise(
        F.array(
            name,
            F.concat(F.lit("refs/heads/"), name),
            F.concat(F.lit("refs/tags/"), name),
            F.concat(F.lit("refs/remotes/origin/"), name),
        )
    )
    tried = wanted.select("repo", "reference", F.posexplode(names).alias("rank", "name"))
    found = (
        tried.join(refs.select("repo", "name", "commit"), ["repo", "name"])
        .groupBy("repo", "reference")
        .agg(F.min_by("commit", "rank").alias("found"))
    )
    answered = spread_join(requests, found, ["repo", "reference"], "left")
    known = defaults.select("repo", F.col("commit").alias("default_commit"))
    both = spread_join(answered, known, ["repo"], "left")
    return both.select(
        *requests.columns,
        F.coalesce("found", "default_commit").alias("commit"),
        F.col("found").isNotNull().alias("reference_found"),
    )


def follow_references(refs: DataFrame) -> DataFrame:
    """``repo, name, commit`` of the references that lead to a commit, symbolic ones (``target``) followed.

    Pointer jumping: in every round each symbolic reference is pointed to where its target points, so
    chains halve and the rounds are the logarithm of the longest one. What still points on when as many
    steps are taken as a repository has symbolic references runs in a circle and leads to no commit, as
    does a target that does not exist. Each round is a written table.
    """
    spark = refs.sparkSession

    def written(df: DataFrame) -> DataFrame:
        folder = workspace(spark)
        df.write.parquet(folder)
        return spark.read.schema(df.schema).parquet(folder)

    known = refs.where("target is null").select("repo", "name", "commit")
    open_ = written(refs.where("target is not null").select("repo", "name", "target"))
    longest = open_.groupBy("repo").count().agg(F.max("count")).first()[0] or 0
    steps = 1
    while longest:
        ends = known.select("repo", F.col("name").alias("target"), "commit")
        arrived = written(open_.join(ends, ["repo", "target"]).select("repo", "name", "commit"))
        known = known.unionByName(arrived)
        if steps > longest:
            break
        rest = open_.join(arrived.select("repo", "name"), ["repo", "name"], "left_anti")
        onward = open_.select("repo", F.col("name").alias("target"), F.col("target").alias("__next"))
        jumped = rest.join(onward, ["repo", "target"]).select("repo", "name", F.col("__next").alias("target"))
        open_, steps = written(jumped), 2 * steps
        if open_.isEmpty():
            break
    return known
