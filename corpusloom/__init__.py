"""Corpus preparation on Spark: files or rows in, clean and reviewable documents out."""

from .operators.admit import admission_log, admit, flag_files, sample_files, status_counts
from .operators.ignore import drop_ignored, drop_vcs, ignored_files, parse_rules, rules_in_corpus
from .operators.matches import (
    line_table,
    match_headers,
    match_table,
    matches_by_line,
    show_matches,
)
from .operators.order import in_order, numbered
from .operators.rules import (
    DEFAULT_RULES,
    EXTENDED_RULES,
    Rule,
    applicable_rules,
    match_counts,
    redaction_totals,
    rewrite,
    rules_from_table,
)
from .operators.snapshots import compare_snapshots, resolve_references, select_subpath
from .operators.tree import directories, tree, tree_lines, tree_order, tree_text
from .plans.documents import (
    assemble,
    document_totals,
    numbered_pieces,
    pieces,
    section,
    tree_parts,
    whole_documents,
    write_document,
)
from .plans.ingest import ingest
from .plans.written import commit_document, manifest, read_bytes, read_ranges
from .sources.files import list_files, read_corpus, read_files, write_files
from .sources.listed import commit_listing, read_listing
from .sources.tables import corpus_from_table
