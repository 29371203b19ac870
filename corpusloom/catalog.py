"""The queries over the shared test tables, each with its SQL check.

The tables become one corpus: documents as ``.txt``, pages as ``.html``,
conversation turns as ``.json`` and events as ``.cfg`` files, all rows of each.
A bundle is a range of ids, so its size is bounded however rows are spread over
sources, languages or conversations.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths, sizes, specs
from .functions.languages import fence_language
from .operators import admit as admission
from .operators import ignore, matches, order, rules, snapshots, tree
from .operators.rules import DEFAULT_RULES, EXTENDED_RULES, Rule
from .plans import documents, written
from .sources import files as file_source
from .sources import listed
from .sources.tables import corpus_from_table
from .sources.workspace import workspace

SMALL = 4096

# Rules of the queries that need more than the defaults.
QUOTED_SECRET = Rule("redact", r'(?i)\x73ecret\s*[:=]\s*"?(?:[a-z]|\d|[+/])+=*')
NAVIGATION = Rule("truncate", r"<nav\b[^>]*>.*?</nav>", r"\.html?$")
ENTITY = Rule("truncate", r"&[a-z]+;", r"\.html?$")
TIMEOUT = Rule("truncate", r"\p{Ll}+out=[0-9]+")
CUSTOM_RULES = (QUOTED_SECRET, NAVIGATION, TIMEOUT)

# Classes with set operations, in classes, and with blanks and notes between.
CLASS_RULES = (
    Rule("redact", r"""(?x) pass[a-z&&[wW]]ord \s* = \s*  # the name, then
        [ [:alnum:] -- [:digit:] ]+  # letters only"""),
    Rule("truncate", r"[a-z&&[^aeiou]]{4,}", r"(?x) \. [ t x && [^h] ]+ $"),
    Rule("truncate", r"(?i)&[a-f~~d-z]+;", r"\.html?$"),
    Rule("truncate", r"(?-u:\d)[[0-4][8-9]]{2,}", r"\.cfg$"),
)
# The same with the classes spelt out.
SPELT_RULES = (
    Rule("redact", r"password\s*=\s*[A-Za-z]+"),
    Rule("truncate", r"[b-df-hj-np-tv-z]{4,}", r"\.[tx]+$"),
    Rule("truncate", r"&[a-cg-zA-CG-Z]+;", r"\.html?$"),
    Rule("truncate", r"[0-9][0-489]{2,}", r"\.cfg$"),
)

# File name endings dealt out over the documents of the name-based queries.
ENDINGS = (
    ".txt", ".md", ".rs", ".RS", ".py", ".css", ".CSS", ".html", ".yml", ".svg", ".PNG",
    ".tar.GZ", ".sqlite", ".tfvars", ".", "", ".d.ts", ".dockerfile",
)


# Columns of the test tables that the queries use; naming them saves a look at the files.
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "events": "event_id bigint, user_id bigint, event_type string",
    "customer": "c_custkey bigint, c_name string, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _join(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _range(column: str, width: int) -> Column:
    return F.call_function("div", F.col(column), F.lit(width)).cast("string")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.expr("concat('docs/', source, '/', lang, '/', doc_id, '.txt')")
    bundle = F.expr("concat('docs-', doc_id div 64) AS bundle")
    return corpus_from_table(table(spark, sf_dir, "documents"), path, "text", bundle)


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.expr("concat('pages/', page_id, '.html')")
    bundle = F.expr("concat('pages-', page_id div 64) AS bundle")
    return corpus_from_table(table(spark, sf_dir, "pages"), path, "html", bundle)


def turn_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.expr("concat('conversations/', conv_id, '/', turn, '.json')")
    bundle = F.expr("concat('chat-', conv_id div 16, '-', turn div 64) AS bundle")
    content = F.expr("to_json(struct(text AS content, role))")
    return corpus_from_table(table(spark, sf_dir, "conversations"), path, content, bundle)


def event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.expr("concat('conf/', event_type, '/', event_id, '.cfg')")
    bundle = F.expr("concat('conf-', event_id div 256) AS bundle")
    content = F.expr(
        r"concat('user=', user_id, '\npassword=pw', event_id, '\napi_key: k', user_id, '\ntimeout=30')"
    )
    return corpus_from_table(table(spark, sf_dir, "events"), path, content, bundle)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``bundle, path, content, size`` over the four tables."""
    parts = (document_files, page_files, turn_files, event_files)
    first, *rest = (part(spark, sf_dir) for part in parts)
    for part in rest:
        first = first.unionByName(part)
    return first


def named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents under names with every kind of ending."""
    ending = F.element_at(
        F.array(*map(F.lit, ENDINGS)), (F.pmod("doc_id", F.lit(len(ENDINGS))) + 1).cast("int")
    )
    path = _join("files/", F.col("source"), "/", F.col("doc_id"), ending)
    return corpus_from_table(table(spark, sf_dir, "documents"), path, "text")


def secret_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script per customer with one secret of every documented shape."""
    key = F.col("c_custkey").cast("string")
    digest = F.md5(key.cast("binary"))
    longer = F.concat(digest, F.md5(F.concat(key, F.lit("x")).cast("binary")))
    content = F.concat_ws(
        "\n",
        _join("a = 'ghp_", F.left(longer, F.lit(36)), "'"),
        _join("b = 'sk-", F.left(longer, F.lit(48)), "'"),
        _join("c = 'eyJ", digest, ".eyJ", digest, ".", digest, "'"),
        _join("d = 'AKIA", F.upper(F.left(digest, F.lit(16))), "'"),
        _join("e = 'xoxb-", F.lpad(key, 13, "1"), "-", F.lpad(key, 13, "2"), "-",
              F.left(digest, F.lit(24)), "'"),
        _join("hash: ", digest),
        _join("key = ", F.left(digest, F.lit(8)), "-1111-2222-3333-444444444444"),
        _join("name = ", F.col("c_name")),
    )
    path = _join("vault/", F.col("c_mktsegment"), "/", key, ".py")
    return corpus_from_table(table(spark, sf_dir, "customer"), path, content)


def _text_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.admit(corpus(spark, sf_dir))


def _digest(files: DataFrame) -> DataFrame:
    return files.select(
        "path",
        "status",
        sizes.byte_length("content").alias("bytes"),
        F.md5(F.col("content").cast("binary")).alias("digest"),
    )


def corpus_counts(spark, sf_dir):
    files = corpus(spark, sf_dir)
    return files.groupBy(paths.extension("path").alias("ext")).agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes")
    )


def path_parts(spark, sf_dir):
    docs = named_files(spark, sf_dir)
    windows = F.translate("path", "/", "\\")
    path = paths.normalize_path(F.col("windows"))
    return docs.select(windows.alias("windows")).select(
        path.alias("path"),
        paths.file_name(path).alias("name"),
        paths.extension(path).alias("ext"),
        paths.relative_to(path, "files/src1").alias("shown"),
        paths.parent(path).alias("dir"),
        paths.depth(path).alias("depth"),
    )


def language(spark, sf_dir):
    return named_files(spark, sf_dir).select("path", fence_language("path").alias("language"))


def file_flags(spark, sf_dir):
    files = admission.flag_files(named_files(spark, sf_dir), SMALL)
    return files.select("path", "size", "is_binary", "is_oversized")


def admit_status(spark, sf_dir):
    files = admission.admit(named_files(spark, sf_dir), SMALL)
    stub = F.when(F.col("status") != "text", F.col("content"))
    return files.select("path", "status", "reason", stub.alias("stub"))


def status_counts(spark, sf_dir):
    files = corpus(spark, sf_dir).unionByName(
        named_files(spark, sf_dir), allowMissingColumns=True
    )
    return admission.status_counts(admission.admit(files, SMALL))


def binary_content(spark, sf_dir):
    """Documents with other bytes in front or behind, by language."""
    text = F.col("text").cast("binary")
    front = {"en": "", "fr": "89504E470D0A", "de": "EFBBBF0041", "es": "C328"}
    head = F.lit(bytes.fromhex("00"))
    for lang, digits in front.items():
        head = F.when(F.col("lang") == lang, F.lit(bytes.fromhex(digits))).otherwise(head)
    raw = F.concat(head, text)
    files = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("path"),
        raw.alias("raw"),
        F.octet_length(raw).cast("bigint").alias("size"),
    )
    return admission.admit(files).select("path", "size", "status", "reason")


def text_content(spark, sf_dir):
    """Pages with a NUL and a beginning, by number: some beginnings tell a text whatever follows."""
    starts = ("", "<!doctype HTML>", " \n<html >", "<htm>", "#!/bin/sh\n", "#!AMR\n", "<?xml ?>", "<!-- ", "x<p>", "<P>", "<br/>", "BMW ")
    start = F.element_at(F.array(*map(F.lit, starts)), (F.pmod("page_id", F.lit(len(starts))) + 1).cast("int"))
    raw = F.concat(start.cast("binary"), F.lit(bytes(1)), F.col("html").cast("binary"))
    files = table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("path"), raw.alias("raw"), F.octet_length(raw).cast("bigint").alias("size")
    )
    return admission.admit(files).select("path", "size", "status", "reason")


def admission_log(spark, sf_dir):
    return admission.admission_log(admission.admit(named_files(spark, sf_dir), SMALL))


def token_estimate(spark, sf_dir):
    n = sizes.byte_length("content")
    return corpus(spark, sf_dir).select(
        "path", n.alias("bytes"), sizes.token_estimate(n).alias("tokens")
    )


def redact_default(spark, sf_dir):
    return _digest(rules.rewrite(_text_corpus(spark, sf_dir), DEFAULT_RULES[:3]))


def truncate_style(spark, sf_dir):
    pages = admission.admit(page_files(spark, sf_dir))
    return rules.rewrite(pages, [DEFAULT_RULES[3]]).select("path", "content")


def truncate_svg(spark, sf_dir):
    drawn = F.concat(
        F.lit('<div><svg width="9">'), F.lit("<circle r='"), F.col("page_id"), F.lit("'/></svg></div>"), "html"
    )
    path = _join("drawn/", F.col("page_id"), ".htm")
    pages = corpus_from_table(table(spark, sf_dir, "pages"), path, drawn)
    return _digest(rules.rewrite(admission.admit(pages), [DEFAULT_RULES[4]]))


def truncate_json(spark, sf_dir):
    turns = admission.admit(turn_files(spark, sf_dir))
    return rules.rewrite(turns, [DEFAULT_RULES[5]]).select("path", "content")


def truncate_generic(spark, sf_dir):
    pages = admission.admit(page_files(spark, sf_dir))
    return _digest(rules.rewrite(pages, [NAVIGATION, ENTITY]))


def css_collapse(spark, sf_dir):
    files = rules.rewrite(admission.admit(named_files(spark, sf_dir)))
    return _digest(files)


def rule_chain(spark, sf_dir):
    return _digest(rules.rewrite(_text_corpus(spark, sf_dir)))


def custom_rules(spark, sf_dir):
    return _digest(rules.rewrite(_text_corpus(spark, sf_dir), CUSTOM_RULES))


def class_rules(spark, sf_dir):
    """Rules whose classes are sets worked out of others."""
    return _digest(rules.rewrite(_text_corpus(spark, sf_dir), CLASS_RULES))


def extended_rules(spark, sf_dir):
    files = admission.admit(secret_files(spark, sf_dir))
    return rules.rewrite(files, EXTENDED_RULES).select("path", "content")


def rule_applicability(spark, sf_dir):
    return rules.applicable_rules(corpus(spark, sf_dir))


def match_counts(spark, sf_dir):
    return rules.match_counts(_text_corpus(spark, sf_dir))


def redaction_totals(spark, sf_dir):
    return rules.redaction_totals(_text_corpus(spark, sf_dir))


def match_spans(spark, sf_dir):
    return matches.match_table(_text_corpus(spark, sf_dir)).select(
        "path", "rule_id", "start", "len", "char_start"
    )


def match_lines(spark, sf_dir):
    found = matches.match_table(_text_corpus(spark, sf_dir), CUSTOM_RULES)
    return found.where("not at_break").select(
        "path", "rule_id", "line_no", "line_offset", "start", "len"
    )


def line_offsets(spark, sf_dir):
    return matches.line_table(corpus(spark, sf_dir)).select("path", "line_no", "start", "len")


def safe_log(spark, sf_dir):
    log = matches.show_matches(_text_corpus(spark, sf_dir), CUSTOM_RULES)
    return log.select("path", "rule_id", "start", "message")


def unsafe_log(spark, sf_dir):
    log = matches.show_matches(_text_corpus(spark, sf_dir), safe=False)
    return log.select("path", "rule_id", "start", "shown")


def log_headers(spark, sf_dir):
    return matches.match_headers(_text_corpus(spark, sf_dir), CUSTOM_RULES)


def lines_grouped(spark, sf_dir):
    grouped = matches.matches_by_line(_text_corpus(spark, sf_dir), [ENTITY, *CUSTOM_RULES])
    return grouped.select(
        "path", "rule_id", "line_no", "matches", F.array_join("shown", "; ").alias("shown")
    )


def tree_dirs(spark, sf_dir):
    return tree.directories(corpus(spark, sf_dir))


def tree_lines(spark, sf_dir):
    return order.in_order(tree.tree_lines(corpus(spark, sf_dir)), tree.tree_order())


def path_order(spark, sf_dir):
    return order.in_order(corpus(spark, sf_dir).select("path", "size"), [paths.path_key("path")])


def sample_files(spark, sf_dir):
    return admission.sample_files(corpus(spark, sf_dir))


def _sections(spark, sf_dir, **options):
    files = rules.rewrite(_text_corpus(spark, sf_dir))
    text = documents.section(**options)
    return files.select("path", F.md5(text.cast("binary")).alias("digest"),
                        sizes.byte_length(text).alias("bytes"))


def md_sections(spark, sf_dir):
    return _sections(spark, sf_dir)


def xml_sections(spark, sf_dir):
    return _sections(spark, sf_dir, format="xml")


def xml_escaped(spark, sf_dir):
    return _sections(spark, sf_dir, format="xml", escape=True)


def json_records(spark, sf_dir):
    files = rules.rewrite(_text_corpus(spark, sf_dir))
    return files.select("path", documents.json_record().alias("record"))


def _bundles(spark, sf_dir, name):
    cells = documents.whole_documents(corpus(spark, sf_dir), "bundle", format=name)
    return cells.select(
        "bundle",
        sizes.byte_length("document").alias("bytes"),
        F.md5(F.col("document").cast("binary")).alias("digest"),
    )


def md_bundle(spark, sf_dir):
    return _bundles(spark, sf_dir, "md")


def xml_bundle(spark, sf_dir):
    return _bundles(spark, sf_dir, "xml")


def json_bundle(spark, sf_dir):
    return _bundles(spark, sf_dir, "json")


def document_parts(spark, sf_dir):
    """One large document per top directory: every piece with its place."""
    top = F.split_part("path", F.lit("/"), F.lit(1))
    files = corpus(spark, sf_dir).drop("bundle").withColumn("top", top)
    placed = documents.numbered_pieces(files, "top")
    return placed.select("top", "position", F.md5(F.col("piece").cast("binary")).alias("digest"))


def tree_text(spark, sf_dir):
    return tree.tree_text(corpus(spark, sf_dir), "bundle")


def bundle_totals(spark, sf_dir):
    return documents.document_totals(corpus(spark, sf_dir), by="bundle")


def document_totals(spark, sf_dir):
    return documents.document_totals(corpus(spark, sf_dir))


def _written_lines(spark, folder, sep="\n"):
    """Lines of a written document with their places.

    What is moved to be numbered is what a digest is made of: short lines, and the digests of longer ones.
    """
    long, line = F.octet_length("value") > 32, F.col("value").cast("binary")
    held = spark.read.option("lineSep", sep).text(folder).select(F.when(~long, line).alias("short"),
                                          F.when(long, F.unhex(F.md5(line))).alias("long"),
                                          F.col("_metadata.file_name").alias("file"),
                                          F.col("_metadata.file_block_start").alias("block"),
                                          F.monotonically_increasing_id().alias("at"))
    lines = order.in_order(held, ["file", "block", "at"])
    return lines.select("position", F.coalesce(F.lower(F.hex("long")), F.md5("short")).alias("digest"))


def document_sink(spark, sf_dir):
    """Write the whole corpus as one document and read its lines back."""
    folder = workspace(spark)
    documents.write_document(corpus(spark, sf_dir), folder)
    return _written_lines(spark, folder)


def json_sink(spark, sf_dir):
    """Write the whole corpus as one JSON object and read back the tree's lines and all others."""
    folder = workspace(spark)
    documents.write_document(corpus(spark, sf_dir), folder, format="json")
    tree_part = _written_lines(spark, f"{folder}/0-tree", "\\n").withColumn("part", F.lit("tree"))
    return tree_part.unionByName(_written_lines(spark, f"{folder}/1-files").withColumn("part", F.lit("files")))


def document_ranges(spark, sf_dir):
    """Write the whole corpus as one JSON object, commit it, and read a byte range of it for every document."""
    folder = workspace(spark)
    parts = written.commit_document(corpus(spark, sf_dir), folder, format="json")
    total = F.lit(parts.agg(F.max(F.col("start") + F.col("bytes"))).first()[0] or 1)
    length = F.coalesce(F.octet_length("text"), F.lit(0)) % 5000 + 1
    wanted = table(spark, sf_dir, "documents").select(
        "doc_id", (F.col("doc_id") * 9973 % total).alias("start"), length.cast("bigint").alias("length")
    )
    pieces = written.read_ranges(spark, folder, wanted.withColumn("document", F.lit(None).cast("string")))
    data = F.transform(F.array_sort(F.collect_list(F.struct("part", "data"))), lambda p: F.hex(p["data"]))
    found = pieces.groupBy("start", "length").agg(F.md5(F.unhex(F.array_join(data, ""))).alias("digest"))
    return wanted.join(found, ["start", "length"]).select("doc_id", "start", "length", "digest")


def source_specs(spark, sf_dir):
    host = F.regexp_extract("url", "://([^/]+)", 1)
    forms = F.array(
        F.col("url"),
        _join(F.col("url"), "@v", F.col("page_id"), "#docs/api"),
        _join("git@", host, ":team/", F.col("page_id"), ".git"),
        _join("git@", host, ":team/", F.col("page_id"), ".git:src"),
        _join("GIT@", host, ":team/p.git@b", F.col("page_id"), ":src/lib"),
        _join("./local/", F.col("page_id"), ".git@main"),
        _join("./local/", F.col("page_id"), "@main#"),
    )
    given = table(spark, sf_dir, "pages").select(F.explode(forms).alias("spec"))
    parsed = given.withColumn("s", specs.source_spec("spec"))
    return parsed.select("spec", "s.*", specs.is_remote("s.url").alias("remote"))


def size_literals(spark, sf_dir):
    unit = F.element_at(
        F.array(*map(F.lit, ("", "K", "m", "G", "KB", " M", "x"))),
        (F.pmod("doc_id", F.lit(7)) + 1).cast("int"),
    )
    docs = table(spark, sf_dir, "documents")
    literal = F.concat(F.lit(" "), "n_chars", unit)
    return docs.select("doc_id", literal.alias("literal")).withColumn(
        "bytes", sizes.parse_size("literal")
    )


def subpath(spark, sf_dir):
    return snapshots.select_subpath(corpus(spark, sf_dir), "docs/src1/").select("path", "size")


def vcs_dirs(spark, sf_dir):
    place = F.when(F.col("lang") == "en", "/.git/").when(F.col("lang") == "fr", "/.github/")
    path = _join(F.col("source"), F.coalesce(place, F.lit("/")), F.col("doc_id"))
    plain = F.when(F.col("lang") == "de", F.concat(path, F.lit("/.git"))).otherwise(path)
    files = table(spark, sf_dir, "documents").select(plain.alias("path"))
    return ignore.drop_vcs(files)


def ref_select(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    repo = _join("r", _range("c_custkey", 100)).alias("repo")
    commit = F.md5(key.cast("binary")).alias("commit")
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "refs/tags/c").when(
        F.col("c_mktsegment") == "MACHINERY", "refs/remotes/origin/c"
    )
    named = customers.select(
        repo, F.concat(F.coalesce(kind, F.lit("refs/heads/c")), key).alias("name"), commit
    )
    by_id = customers.select(repo, commit.alias("name"), commit)
    defaults = customers.select(repo).distinct().withColumn(
        "commit", F.md5(F.col("repo").cast("binary"))
    )
    asked = F.col("o_custkey").cast("string")
    reference = (
        F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("c"), asked))
        .when(F.col("o_orderstatus") == "F", F.concat(F.lit("refs/tags/c"), asked))
        .when(F.col("o_orderpriority") == "5-LOW", F.md5(asked.cast("binary")))
    )
    requests = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        _join("r", _range("o_custkey", 100)).alias("repo"),
        reference.alias("reference"),
    )
    return snapshots.resolve_references(requests, named.unionByName(by_id), defaults)


def ref_symbolic(spark, sf_dir):
    """Branches in chains that end at a commit, in nothing, or in a circle, and the orders' wishes for them."""
    key = F.col("c_custkey")
    name = lambda k: F.concat(F.lit("refs/heads/c"), k.cast("string"))
    # Of eight: one commit, a chain of three to it, a circle of two, one that points to itself, one to nothing.
    part = F.pmod(key, F.lit(8))
    target = (
        F.when(part.isin(1, 2, 3), name(key - 1)).when(part == 4, name(key + 1)).when(part == 5, name(key - 1))
        .when(part == 6, name(key)).when(part == 7, F.lit("refs/heads/none"))
    )
    repo = _join("r", _range("c_custkey", 64)).alias("repo")
    refs = table(spark, sf_dir, "customer").select(
        repo, name(key).alias("name"), F.when(part == 0, F.md5(key.cast("string").cast("binary"))).alias("commit"), target.alias("target")
    )
    defaults = refs.select("repo").distinct().withColumn("commit", F.md5(F.col("repo").cast("binary")))
    requests = table(spark, sf_dir, "orders").select(
        "o_orderkey", _join("r", _range("o_custkey", 64)).alias("repo"), _join("c", F.col("o_custkey")).alias("reference")
    )
    return snapshots.resolve_references(requests, refs, defaults)


def snapshot_diff(spark, sf_dir):
    docs = document_files(spark, sf_dir)
    before = docs.unionByName(page_files(spark, sf_dir))
    after = rules.rewrite(admission.admit(docs), CUSTOM_RULES).select("path", "content")
    after = after.unionByName(turn_files(spark, sf_dir).select("path", "content"))
    return snapshots.compare_snapshots(before, after)


def ignored(spark, sf_dir):
    files = corpus(spark, sf_dir).select("path")
    top = F.array(
        *map(F.lit, ("# rules of the top directory", "", "*7.txt", "/conf/view/",
                     "conversations/*/1.json", "pages/**/1?.html", "purchase/", "!*77.txt"))
    )
    first = spark.range(1).select(F.lit("").alias("owner"), F.posexplode(top).alias("n", "line"))
    machine = spark.createDataFrame([("", "global", 0, "*/de/*9.txt")], "owner string, kind string, n int, line string")
    # Each source takes its Spanish files out and one kind of file back in.
    sources = table(spark, sf_dir, "documents").select("source").distinct()
    per_source = sources.select(
        F.concat(F.lit("docs/"), "source").alias("owner"),
        F.posexplode(F.array(*map(F.lit, ("es/", "!en/*17.txt", "de/[]0-4]*.txt", "fr[", "[9-0].txt")))).alias("n", "line"),
    )
    own = first.unionByName(per_source).withColumn("kind", F.lit("gitignore"))
    lines = own.unionByName(machine).withColumnRenamed("n", "line_no")
    return ignore.ignored_files(files, ignore.parse_rules(lines))


def ignored_by_name(spark, sf_dir):
    """A rule file with a line for every seventh page and every eleventh turn, next to patterns."""
    files = corpus(spark, sf_dir).select("path")
    pages, turns = table(spark, sf_dir, "pages"), table(spark, sf_dir, "conversations")
    lines = [
        pages.where("page_id % 7 = 0").select(F.col("page_id").alias("n"), _join("/pages/", F.col("page_id"), ".html").alias("line")),
        turns.where("(conv_id + turn) % 11 = 0").select("conv_id", _join("conversations/", F.col("conv_id"), "/", F.col("turn"), ".json")),
        spark.createDataFrame([(1 << 40, "*5.cfg"), ((1 << 40) + 1, "!85.cfg"), ((1 << 40) + 2, "1*"), ((1 << 40) + 3, "!/pages/14*.html")], "n long, line string"),
    ]
    given = lines[0].union(lines[1]).union(lines[2]).select(
        F.lit("").alias("owner"), F.lit("gitignore").alias("kind"), F.col("n").alias("line_no"), "line"
    )
    return ignore.ignored_files(files, ignore.parse_rules(given))


def unknown_rule_type(spark, sf_dir):
    """A rule of a type that doesn't exist is skipped."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return _digest(rules.rewrite(_text_corpus(spark, sf_dir), [Rule("mask", "password"), TIMEOUT]))


def bad_pattern(spark, sf_dir):
    """Files that an unusable pattern would touch become error rows."""
    broken = Rule("redact", "(unclosed", r"\.(cfg|json)$")
    done = rules.rewrite(_text_corpus(spark, sf_dir), [TIMEOUT, broken], on_bad_pattern="stub")
    return done.select("path", "status", F.when(F.col("status") != "error", F.md5("content")).alias("digest"))


def _as_files(spark, files):
    folder = workspace(spark)
    file_source.write_files(files.select("path", F.col("content").cast("binary").alias("raw")), folder)
    return folder


def file_scan(spark, sf_dir):
    """Documents written as files, and the folder listed."""
    folder = _as_files(spark, document_files(spark, sf_dir))
    return file_source.list_files(spark, folder, folder).select("path", "size")


def flat_scan(spark, sf_dir):
    """All documents as files of one directory, listed with a base outside it: paths stay whole."""
    files = table(spark, sf_dir, "documents").select(_join("flat/", F.col("doc_id")).alias("path"), F.col("text").alias("content"))
    folder = _as_files(spark, files)
    found = file_source.list_files(spark, f"{folder}/flat", f"{folder}/flat/elsewhere")
    return found.select(paths.relative_to("path", folder).alias("path"), "size")


def file_admission(spark, sf_dir):
    """Documents written as files of all kinds of names, read and admitted up to the default limit."""
    folder = _as_files(spark, named_files(spark, sf_dir))
    files = admission.admit(file_source.read_corpus(spark, folder, folder))
    return files.select("path", "size", "status", "reason", F.md5(F.col("content").cast("binary")).alias("digest"))


def file_contents(spark, sf_dir):
    """Documents written as files, read back whole (up to the default limit) and admitted."""
    folder = _as_files(spark, named_files(spark, sf_dir))
    files = admission.admit(file_source.read_corpus(spark, folder, folder))
    return files.select("path", "size", "status", "reason", F.md5(F.col("content").cast("binary")).alias("digest"))


def file_pushdown(spark, sf_dir):
    """Documents written as files, listed and committed; of some kinds and sizes the bytes are read."""
    folder = _as_files(spark, document_files(spark, sf_dir))
    listing = listed.commit_listing(file_source.list_files(spark, folder, folder))
    files = listed.read_listing(spark, listing).where("path LIKE 'docs/src1/%' AND size >= 500 AND size < 20000")
    return files.select("path", "size", F.md5("raw").alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        corpus_counts, path_parts, language, file_flags, admit_status, status_counts,
        binary_content, text_content, admission_log, token_estimate, redact_default, truncate_style, truncate_svg,
        truncate_json, truncate_generic, css_collapse, rule_chain, custom_rules, class_rules,
        extended_rules, rule_applicability, match_counts, redaction_totals, match_spans,
        match_lines, line_offsets, safe_log, unsafe_log, log_headers, lines_grouped,
        tree_dirs, tree_lines, tree_text, path_order, sample_files, md_sections, xml_sections,
        xml_escaped, json_records, md_bundle, xml_bundle, json_bundle, bundle_totals,
        document_totals, document_parts, document_sink, json_sink, document_ranges, source_specs, size_literals, subpath, vcs_dirs,
        ref_select, ref_symbolic, snapshot_diff, ignored, ignored_by_name, unknown_rule_type, bad_pattern, file_scan,
        flat_scan, file_admission, file_contents, file_pushdown,
    )
}
