"""SQL that gives the same answers as the catalog's queries, for a second engine.

Plain ANSI-style SQL with lists and ``regexp_*`` as DuckDB writes them. Rule
patterns are used as written, without the translation that Spark needs.
"""

from __future__ import annotations

from . import catalog as c
from .functions.languages import FENCE_LANGUAGE
from .functions.sniffing import BINARY_EXTENSIONS
from .operators.rules import DEFAULT_RULES, EXTENDED_RULES, STYLESHEET_TEXT, Rule
from .plans.documents import (
    JSON_BETWEEN,
    JSON_END,
    JSON_HEAD,
    JSON_TREE_END,
    MARKDOWN_HEAD,
    MARKDOWN_TREE_END,
    XML_HEAD,
    XML_TREE_END,
)


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _lines(text: str) -> str:
    """A literal with line feeds."""
    return "(" + " || chr(10) || ".join(_q(part) for part in text.split("\n")) + ")"


def _list(items) -> str:
    return "[" + ", ".join(map(_q, items)) + "]"


NAME = "regexp_extract({0}, '[^/]*$')"


def _ext(path: str) -> str:
    return f"regexp_extract({NAME.format(path)}, '^.+\\.([^.]*)$', 1)"


DOCS = """SELECT 'docs-' || (doc_id // 64) AS bundle,
  'docs/' || source || '/' || lang || '/' || doc_id || '.txt' AS path, text AS content FROM documents"""
PAGES = """SELECT 'pages-' || (page_id // 64) AS bundle,
  'pages/' || page_id || '.html' AS path, html AS content FROM pages"""
TURNS = """SELECT 'chat-' || (conv_id // 16) || '-' || (turn // 64) AS bundle,
  'conversations/' || conv_id || '/' || turn || '.json' AS path,
  CAST(to_json({'content': text, 'role': role}) AS VARCHAR) AS content FROM conversations"""
EVENTS = """SELECT 'conf-' || (event_id // 256) AS bundle,
  'conf/' || event_type || '/' || event_id || '.cfg' AS path,
  'user=' || user_id || chr(10) || 'password=pw' || event_id || chr(10)
  || 'api_key: k' || user_id || chr(10) || 'timeout=30' AS content FROM events"""
NAMED = f"""SELECT 'files/' || source || '/' || doc_id
  || ({_list(c.ENDINGS)})[doc_id % {len(c.ENDINGS)} + 1] AS path, text AS content FROM documents"""
SECRETS = """SELECT 'vault/' || c_mktsegment || '/' || c_custkey || '.py' AS path,
  'a = ''ghp_' || substr(l, 1, 36) || '''' || chr(10) || 'b = ''sk-' || substr(l, 1, 48) || ''''
  || chr(10) || 'c = ''eyJ' || d || '.eyJ' || d || '.' || d || ''''
  || chr(10) || 'd = ''AKIA' || upper(substr(d, 1, 16)) || ''''
  || chr(10) || 'e = ''xoxb-' || lpad(k, 13, '1') || '-' || lpad(k, 13, '2') || '-' || substr(d, 1, 24) || ''''
  || chr(10) || 'hash: ' || d
  || chr(10) || 'key = ' || substr(d, 1, 8) || '-1111-2222-3333-444444444444'
  || chr(10) || 'name = ' || c_name AS content
FROM (SELECT *, CAST(c_custkey AS VARCHAR) AS k, md5(CAST(c_custkey AS VARCHAR)) AS d,
  md5(CAST(c_custkey AS VARCHAR)) || md5(c_custkey || 'x') AS l FROM customer)"""
DRAWN = """SELECT 'drawn/' || page_id || '.htm' AS path,
  '<div><svg width="9"><circle r=''' || page_id || '''/></svg></div>' || html AS content FROM pages"""
CORPUS = " UNION ALL ".join((DOCS, PAGES, TURNS, EVENTS))


def _admitted(files: str, max_size: int = 4 << 20) -> str:
    """CTEs ``files`` and ``c0`` (path, status, content and more), as text files hold no binary."""
    ext = _ext("path")
    return f"""files AS ({files}),
sized AS (SELECT *, strlen(content) AS size, {ext} AS ext FROM files),
judged AS (SELECT * REPLACE (NULL AS content), content AS given,
  CASE WHEN size > {max_size} THEN 'oversize'
  WHEN lower(ext) IN ({", ".join(map(_q, BINARY_EXTENSIONS))}) THEN 'binary extension'
  WHEN lower(ext) = 'css' THEN 'stylesheet' ELSE 'text' END AS reason FROM sized),
c0 AS (SELECT * REPLACE (
  CASE status WHEN 'text' THEN given WHEN 'oversized' THEN '[file too large: ' || size || ' bytes]'
  ELSE '[binary skipped]' END AS content)
  FROM (SELECT *, CASE reason WHEN 'oversize' THEN 'oversized' WHEN 'binary extension' THEN 'binary'
  ELSE 'text' END AS status FROM judged))"""


def _applies(rule: Rule) -> str:
    live = "status = 'text' AND lower(ext) <> 'css'"
    if rule.file_pattern:
        return f"{live} AND regexp_matches(path, {_q(rule.file_pattern)})"
    return live


def _chain(rules) -> str:
    """CTEs c1, c2, ... each one rule further, then ``done`` with stylesheets blanked."""
    steps = [
        f"""c{i} AS (SELECT * REPLACE (CASE WHEN {_applies(r)}
  THEN regexp_replace(content, {_q(r.pattern)}, {_q(r.replacement)}, 'g')
  ELSE content END AS content) FROM c{i - 1})"""
        for i, r in enumerate(rules, 1)
    ]
    steps.append(
        f"""done AS (SELECT * REPLACE (CASE WHEN status = 'text' AND lower(ext) = 'css'
  THEN {_q(STYLESHEET_TEXT)} ELSE content END AS content) FROM c{len(rules)})"""
    )
    return ",\n".join(steps)


def _rewritten(files: str, rules=DEFAULT_RULES, max_size: int = 4 << 20) -> str:
    return f"WITH {_admitted(files, max_size)},\n{_chain(rules)}\n"


DIGEST = "SELECT path, status, strlen(content) AS bytes, md5(content) AS digest FROM done"


def _hits(files: str, rules) -> str:
    """CTE ``hits``: path, rule_id, type, i, text, start, char_start of every match."""
    found = " UNION ALL ".join(
        f"""SELECT path, {i} AS rule_id, '{r.type}' AS type,
  regexp_extract_all(content, {_q(r.pattern)}) AS found,
  string_split_regex(content, {_q(r.pattern)}) AS gaps
FROM c{i - 1} WHERE {_applies(r)} AND regexp_matches(content, {_q(r.pattern)})"""
        for i, r in enumerate(rules, 1)
    )
    before = " + ".join(
        f"coalesce(list_sum(list_transform({part}, lambda x: {{0}}(x))), 0)"
        for part in ("gaps[1:i]", "found[1:i - 1]")
    )
    return f"""{_rewritten(files, rules)},
found AS ({found}),
hits AS (SELECT path, rule_id, type, found[i] AS text,
  CAST({before.format("strlen")} AS BIGINT) AS start,
  CAST({before.format("length")} AS BIGINT) AS char_start
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM found))"""


def _line_table(of: str) -> str:
    """Lines of ``of`` (path, rule_id, content) with their byte offset."""
    return f"""SELECT path, rule_id, line_no, line, CAST(coalesce(sum(strlen(line) + 1) OVER (
  PARTITION BY path, rule_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  AS BIGINT) AS line_start
FROM (SELECT path, rule_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no FROM (
  SELECT path, rule_id, CASE WHEN content = '' THEN [] ELSE string_split(regexp_replace(content, '\\n$', ''), chr(10)) END AS lines
  FROM ({of})))"""


def _placed(files: str, rules) -> str:
    """CTE ``placed``: hits with the line they start in, by an interval join."""
    seen = " UNION ALL ".join(
        f"SELECT path, {i} AS rule_id, content FROM c{i - 1}" for i in range(1, len(rules) + 1)
    )
    return f"""{_hits(files, rules)},
lines AS ({_line_table(f"SELECT s.* FROM ({seen}) s SEMI JOIN hits USING (path, rule_id)")}),
placed AS (SELECT h.*, l.line_no, h.start - l.line_start AS line_offset, strlen(h.text) AS len,
  CASE h.type WHEN 'redact' THEN 'Redaction' ELSE 'Truncation' END AS label
  FROM hits h JOIN lines l ON h.path = l.path AND h.rule_id = l.rule_id
  AND h.start >= l.line_start AND h.start < l.line_start + strlen(l.line))"""


def _ancestors(files: str, keys: str = "") -> str:
    return f"""SELECT DISTINCT {keys} array_to_string(parts[1:k], '/') AS path
FROM (SELECT {keys} parts, unnest(range(1, len(parts))) AS k
  FROM (SELECT {keys} string_split(path, '/') AS parts FROM ({files})))"""


def _tree(files: str, keys: str = "") -> str:
    root = f"SELECT DISTINCT {keys} '' AS path FROM ({files})" if keys else "SELECT '' AS path"
    return f"""SELECT {keys} path, true AS is_dir, 0 AS depth, '.' AS name, '+ .' AS line FROM ({root})
UNION ALL SELECT {keys} path, is_dir, CAST(len(string_split(path, '/')) AS INTEGER) AS depth,
  {NAME.format("path")} AS name,
  repeat('  ', len(string_split(path, '/')) - 1) || CASE WHEN is_dir THEN '+ ' ELSE '- ' END
  || {NAME.format("path")} AS line
FROM (SELECT *, true AS is_dir FROM ({_ancestors(files, keys)})
  UNION ALL SELECT {keys} path, false AS is_dir FROM ({files}))"""


LANGUAGE = (
    "CASE "
    + _ext("path")
    + " "
    + " ".join(f"WHEN {_q(e)} THEN {_q(l)}" for e, l in FENCE_LANGUAGE.items())
    + " ELSE '' END"
)
MD_SECTION = f"""('### `' || path || '`' || chr(10) || chr(10) || CASE WHEN status = 'text'
  THEN '```' || {LANGUAGE} || chr(10) || content || chr(10) || '```' || chr(10) ELSE content END
  || chr(10) || chr(10))"""


def _xml_section(path: str = "path", content: str = "content") -> str:
    return f"""('<file path="' || {path} || '">' || CASE WHEN status = 'text'
  THEN chr(10) || {content} || chr(10) ELSE {content} END || '</file>' || chr(10) || chr(10))"""


def _xml_text(column: str) -> str:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        column = f"replace({column}, {_q(char)}, {_q(name)})"
    return column


RECORD = "CAST(to_json({'content': content, 'path': path}) AS VARCHAR)"
ALL_DONE = _rewritten(CORPUS)
FILE_ORDER = "string_split(path, '/')"


def _documents(head: str, section: str, between: str, tree_end: str, end: str, tree: str) -> str:
    """The document of each bundle, and its totals."""
    return f"""{ALL_DONE},
trees AS (SELECT bundle, {tree} AS tree FROM ({_tree(CORPUS, "bundle,")}) GROUP BY bundle),
bodies AS (SELECT bundle, count(*) AS files,
  string_agg({section}, {between} ORDER BY {FILE_ORDER}) AS body FROM done GROUP BY bundle),
documents_ AS (SELECT bundle, files,
  {head} || tree || {tree_end} || body || {end} AS document FROM trees JOIN bodies USING (bundle))"""


TREE_TEXT = "string_agg(line, chr(10) ORDER BY path, NOT is_dir)"
MD_DOCUMENTS = _documents(
    _lines(MARKDOWN_HEAD), MD_SECTION, "''", "chr(10) || " + _lines(MARKDOWN_TREE_END), "''", TREE_TEXT
)
XML_DOCUMENTS = _documents(
    _lines(XML_HEAD), _xml_section(), "''", "chr(10) || " + _lines(XML_TREE_END), "''", TREE_TEXT
)
JSON_SECTION = f"""({_lines('{' + chr(10) + '      "content": ')} || CAST(to_json(content) AS VARCHAR)
  || {_lines(',' + chr(10) + '      "path": ')} || CAST(to_json(path) AS VARCHAR) || {_lines(chr(10) + '    }')})"""
JSON_DOCUMENTS = _documents(
    _lines(JSON_HEAD.removesuffix('"')), JSON_SECTION, _lines(JSON_BETWEEN),
    _lines(JSON_TREE_END.removeprefix('"')), _lines(JSON_END), f"CAST(to_json({TREE_TEXT}) AS VARCHAR)",
)
BUNDLES = """
SELECT bundle, strlen(document) AS bytes, md5(document) AS digest FROM documents_"""


def _totals(by: str, files: str = CORPUS) -> str:
    """Bytes of Markdown documents added up from their pieces."""
    keys = f"{by}," if by else ""
    group = f"GROUP BY {by}" if by else ""
    on = f"USING ({by})" if by else "ON true"
    frame = strlen(MARKDOWN_HEAD) + strlen(MARKDOWN_TREE_END)
    return f"""{_rewritten(files)},
trees AS (SELECT {keys} sum(strlen(line) + 1) AS n FROM ({_tree(files, keys)}) {group}),
bodies AS (SELECT {keys} count(*) AS files, sum(strlen({MD_SECTION})) AS n FROM done {group}),
totals AS (SELECT {keys} files, CAST(trees.n + bodies.n + {frame} AS BIGINT) AS bytes
  FROM trees JOIN bodies {on})"""


def strlen(text: str) -> int:
    return len(text.encode())


def _ignored() -> str:
    """Every node of every path against the rules written out by hand as regexes."""
    top = [
        (2, False, False, "^(.*/)?[^/]*7\\.txt$"),
        (3, False, True, "^conf/view$"),
        (4, False, False, "^conversations/[^/]*/1\\.json$"),
        (5, False, False, "^pages/(.*/)?1[^/]\\.html$"),
        (6, False, True, "^(.*/)?purchase$"),
        (7, True, False, "^(.*/)?[^/]*77\\.txt$"),
    ]
    own = [
        (0, False, True, "^(.*/)?es$"),
        (1, True, False, "^en/[^/]*17\\.txt$"),
        (2, False, False, "^de/[]0-4][^/]*\\.txt$"),
    ]
    machine = [(-1, False, False, "^[^/]*/de/[^/]*9\\.txt$")]

    def rows(rules, owner: str, source: str) -> str:
        return " UNION ALL ".join(
            f"SELECT {owner} AS owner, {n} AS line_no, {neg} AS negated, {d} AS dir_only, "
            f"{_q(regex)} AS regex {source}"
            for n, neg, d, regex in rules
        )

    return f"""WITH files AS (SELECT path FROM ({CORPUS})),
rules AS ({rows(top, "''", "")} UNION ALL {rows(machine, "''", "")} UNION ALL
  {rows(own, "'docs/' || source", "FROM (SELECT DISTINCT source FROM documents)")}),
nodes AS (SELECT path, array_to_string(parts[1:k], '/') AS node, k < len(parts) AS is_dir
  FROM (SELECT path, string_split(path, '/') AS parts,
    unnest(range(1, len(string_split(path, '/')) + 1)) AS k FROM files)),
verdicts AS (SELECT n.path, n.node,
  arg_max(NOT r.negated, [strlen(r.owner), r.line_no]) AS ignored
  FROM nodes n JOIN rules r ON (r.owner = '' OR starts_with(n.node, r.owner || '/'))
  AND (n.is_dir OR NOT r.dir_only)
  AND regexp_matches(CASE WHEN r.owner = '' THEN n.node ELSE substr(n.node, length(r.owner) + 2) END, r.regex)
  GROUP BY n.path, n.node)
SELECT path, coalesce(bool_or(v.ignored), false) AS ignored
FROM files LEFT JOIN verdicts v USING (path) GROUP BY path"""


PLAIN_SPEC = "NOT (lower(spec) LIKE 'git@%:%' AND NOT starts_with(spec, 'git@http'))"
SPECS = f"""WITH given AS (SELECT page_id, url, regexp_extract(url, '://([^/]+)', 1) AS host FROM pages),
specs AS (SELECT url AS spec FROM given
  UNION ALL SELECT url || '@v' || page_id || '#docs/api' FROM given
  UNION ALL SELECT 'git@' || host || ':team/' || page_id || '.git' FROM given
  UNION ALL SELECT 'git@' || host || ':team/' || page_id || '.git:src' FROM given
  UNION ALL SELECT 'GIT@' || host || ':team/p.git@b' || page_id || ':src/lib' FROM given
  UNION ALL SELECT './local/' || page_id || '.git@main' FROM given
  UNION ALL SELECT './local/' || page_id || '@main#' FROM given),
plain AS (SELECT spec, regexp_extract(spec, '^(.*)#([^#]*)$', ['a', 'b']) AS h,
  contains(spec, '#') AS has_sub FROM specs WHERE {PLAIN_SPEC}),
cut AS (SELECT spec, CASE WHEN has_sub THEN h.a ELSE spec END AS u,
  CASE WHEN has_sub THEN h.b END AS subpath FROM plain),
plain_done AS (SELECT spec,
  CASE WHEN contains(u, '@') THEN regexp_extract(u, '^(.*)@([^@]*)$', 1) ELSE u END AS url,
  subpath, CASE WHEN contains(u, '@') THEN regexp_extract(u, '^(.*)@([^@]*)$', 2) END AS reference FROM cut),
shell AS (SELECT spec, regexp_extract(spec, '^([^:]*):([^@:]*)(@([^:]*))?(:(.*))?$',
  ['host', 'repo', 'at', 'ref', 'colon', 'sub']) AS s FROM specs WHERE NOT ({PLAIN_SPEC})),
parsed AS (SELECT * FROM plain_done UNION ALL SELECT spec, s.host || ':' || s.repo,
  CASE WHEN s.colon <> '' THEN s.sub END, CASE WHEN s.at <> '' THEN s.ref END FROM shell)
SELECT spec, url, subpath, reference,
  regexp_matches(lower(url), '^(https://|http://|git@|ssh://)') OR ends_with(url, '.git') AS remote
FROM parsed"""

REFS = """WITH named AS (SELECT 'r' || (c_custkey // 100) AS repo,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'refs/tags/c' WHEN 'MACHINERY' THEN 'refs/remotes/origin/c'
  ELSE 'refs/heads/c' END || c_custkey AS name, md5(CAST(c_custkey AS VARCHAR)) AS commit FROM customer),
refs AS (SELECT * FROM named UNION ALL SELECT repo, commit, commit FROM named),
requests AS (SELECT o_orderkey, 'r' || (o_custkey // 100) AS repo,
  CASE WHEN o_orderstatus = 'O' THEN 'c' || o_custkey
  WHEN o_orderstatus = 'F' THEN 'refs/tags/c' || o_custkey
  WHEN o_orderpriority = '5-LOW' THEN md5(CAST(o_custkey AS VARCHAR)) END AS reference FROM orders)
SELECT o_orderkey, q.repo, reference,
  coalesce(i.commit, h.commit, t.commit, o.commit, d.commit) AS commit,
  coalesce(i.commit, h.commit, t.commit, o.commit) IS NOT NULL AS reference_found
FROM requests q
LEFT JOIN refs i ON i.repo = q.repo AND i.name = reference
LEFT JOIN refs h ON h.repo = q.repo AND h.name = 'refs/heads/' || reference
LEFT JOIN refs t ON t.repo = q.repo AND t.name = 'refs/tags/' || reference
LEFT JOIN refs o ON o.repo = q.repo AND o.name = 'refs/remotes/origin/' || reference
LEFT JOIN (SELECT DISTINCT repo, md5(repo) AS commit FROM refs) d ON d.repo = q.repo"""

SYMBOLIC = """WITH RECURSIVE refs AS (SELECT c_custkey AS k, c_custkey % 8 AS part FROM customer),
paths AS (SELECT k, k AS place, part, 0 AS steps FROM refs UNION ALL
  SELECT p.k, r.k, r.part, steps + 1 FROM paths p JOIN refs r ON r.k = p.place - 1 WHERE p.part IN (1, 2, 3) AND steps < 9),
ends AS (SELECT k, md5(CAST(place AS VARCHAR)) AS commit FROM paths WHERE part = 0),
wanted AS (SELECT o_orderkey, 'r' || (o_custkey // 64) AS repo, 'c' || o_custkey AS reference, o_custkey AS k FROM orders)
SELECT o_orderkey, repo, reference, coalesce(ends.commit, CASE WHEN EXISTS (FROM refs WHERE refs.k // 64 = wanted.k // 64) THEN md5(repo) END) AS commit,
  ends.commit IS NOT NULL AS reference_found FROM wanted LEFT JOIN ends USING (k)"""

BY_NAME = f"""WITH files AS (SELECT path, {NAME.format("path")} AS name FROM ({CORPUS})),
named AS (SELECT 'pages/' || page_id || '.html' AS path, page_id AS n FROM pages WHERE page_id % 7 = 0
  UNION ALL SELECT 'conversations/' || conv_id || '/' || turn || '.json', conv_id FROM conversations WHERE (conv_id + turn) % 11 = 0),
dirs AS (SELECT DISTINCT unnest(list_transform(range(1, len(p)), lambda k: array_to_string(p[1:k], '/'))) AS dir
  FROM (SELECT string_split(path, '/') AS p FROM files)),
gone AS (SELECT dir FROM dirs WHERE starts_with({NAME.format("dir")}, '1'))
SELECT path, CASE WHEN EXISTS (FROM gone WHERE starts_with(path, dir || '/')) THEN true
  WHEN regexp_matches(path, '^pages/14[^/]*\\.html$') THEN false WHEN starts_with(name, '1') THEN true
  WHEN name = '85.cfg' THEN false WHEN ends_with(name, '5.cfg') THEN true
  ELSE path IN (SELECT path FROM named) END AS ignored FROM files"""

TOPS = f"SELECT *, string_split(path, '/')[1] AS top FROM ({CORPUS})"
LINES_OF_WHOLE = """SELECT unnest(range(len(lines))) AS position, md5(unnest(lines)) AS digest
FROM (SELECT string_split(text[:-2], chr(10)) AS lines FROM whole)"""
ENTITY_RULES = [c.ENTITY, *c.CUSTOM_RULES]

JSON_WHOLE = f"""whole AS (SELECT {_lines(JSON_HEAD.removesuffix('"'))} || (SELECT CAST(to_json({TREE_TEXT}) AS VARCHAR) FROM ({_tree(CORPUS)}))
  || {_lines(JSON_TREE_END.removeprefix('"'))} || string_agg({JSON_SECTION}, {_lines(JSON_BETWEEN)} ORDER BY {FILE_ORDER})
  || {_lines(JSON_END)} AS text FROM done)"""

SQL = {
    "corpus_counts": f"""SELECT {_ext("path")} AS ext, count(*) AS files,
  CAST(sum(strlen(content)) AS BIGINT) AS bytes FROM ({CORPUS}) GROUP BY ext""",
    "path_parts": f"""SELECT path, {NAME.format("path")} AS name, {_ext("path")} AS ext,
  CASE WHEN starts_with(path, 'files/src1/') THEN substr(path, 12) ELSE path END AS shown,
  regexp_extract(path, '^(.*)/', 1) AS dir,
  CAST(len(string_split(path, '/')) AS INTEGER) AS depth FROM ({NAMED})""",
    "language": f"SELECT path, {LANGUAGE} AS language FROM ({NAMED})",
    "file_flags": f"""SELECT path, strlen(content) AS size,
  lower({_ext("path")}) IN ({", ".join(map(_q, BINARY_EXTENSIONS))}) AS is_binary,
  strlen(content) > {c.SMALL} AS is_oversized FROM ({NAMED})""",
    "admit_status": f"""WITH {_admitted(NAMED, c.SMALL)} SELECT path, status, reason,
  CASE WHEN status <> 'text' THEN content END AS stub FROM c0""",
    "status_counts": f"""WITH {_admitted(f"SELECT path, content FROM ({CORPUS}) UNION ALL {NAMED}", c.SMALL)}
SELECT status, count(*) AS files FROM c0 GROUP BY status""",
    "binary_content": """SELECT CAST(doc_id AS VARCHAR) AS path,
  strlen(text) + CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 6 WHEN 'de' THEN 5 WHEN 'es' THEN 2 ELSE 1 END AS size,
  CASE WHEN lang IN ('en', 'de') THEN 'text' ELSE 'binary' END AS status,
  CASE WHEN lang IN ('en', 'de') THEN 'text' WHEN lang = 'es' THEN 'invalid utf-8'
  ELSE 'binary content' END AS reason FROM documents""",
    "text_content": """SELECT CAST(page_id AS VARCHAR) AS path, CAST(strlen(s) + 1 + strlen(html) AS BIGINT) AS size,
  CASE WHEN p IN (1, 2, 4, 6, 7, 9) THEN 'text' ELSE 'binary' END AS status,
  CASE WHEN p IN (1, 2, 4, 6, 7, 9) THEN 'text' ELSE 'binary content' END AS reason
FROM (SELECT *, page_id % 12 AS p, (['', '<!doctype HTML>', ' ' || chr(10) || '<html >', '<htm>', '#!/bin/sh' || chr(10), '#!AMR' || chr(10),
  '<?xml ?>', '<!-- ', 'x<p>', '<P>', '<br/>', 'BMW '])[page_id % 12 + 1] AS s FROM pages)""",
    "admission_log": f"""WITH {_admitted(NAMED, c.SMALL)} SELECT path, 'Filter applied: '
  || CASE reason WHEN 'stylesheet' THEN 'CSS content simplification'
  ELSE 'Binary detection by extension' END || ' - ' || path AS message
FROM c0 WHERE reason IN ('stylesheet', 'binary extension')""",
    "token_estimate": f"""SELECT path, strlen(content) AS bytes,
  CAST((strlen(content) * 13 + 39) // 40 AS BIGINT) AS tokens FROM ({CORPUS})""",
    "redact_default": _rewritten(CORPUS, DEFAULT_RULES[:3]) + DIGEST,
    "truncate_style": _rewritten(PAGES, DEFAULT_RULES[3:4]) + "SELECT path, content FROM done",
    "truncate_svg": _rewritten(DRAWN, DEFAULT_RULES[4:5]) + DIGEST,
    "truncate_json": _rewritten(TURNS, DEFAULT_RULES[5:6]) + "SELECT path, content FROM done",
    "truncate_generic": _rewritten(PAGES, [c.NAVIGATION, c.ENTITY]) + DIGEST,
    "css_collapse": _rewritten(NAMED) + DIGEST,
    "rule_chain": _rewritten(CORPUS) + DIGEST,
    "custom_rules": _rewritten(CORPUS, c.CUSTOM_RULES) + DIGEST,
    "class_rules": _rewritten(CORPUS, c.SPELT_RULES) + DIGEST,
    "extended_rules": _rewritten(SECRETS, EXTENDED_RULES) + "SELECT path, content FROM done",
    "rule_applicability": " UNION ALL ".join(
        f"SELECT path, {i} AS rule_id, '{r.type}' AS type FROM ({CORPUS}) WHERE "
        + (f"regexp_matches(path, {_q(r.file_pattern)})" if r.file_pattern else "true")
        for i, r in enumerate(DEFAULT_RULES, 1)
    ),
    "match_counts": _hits(CORPUS, DEFAULT_RULES)
    + "SELECT path, rule_id, type, count(*) AS matches FROM hits GROUP BY ALL",
    "redaction_totals": _hits(CORPUS, DEFAULT_RULES)
    + """SELECT path, count(*) AS redactions, 'Filter summary: Applied ' || count(*)
  || ' total redaction(s) to ' || path AS message FROM hits WHERE type = 'redact' GROUP BY path""",
    "match_spans": _hits(CORPUS, DEFAULT_RULES)
    + "SELECT path, rule_id, start, strlen(text) AS len, char_start FROM hits",
    "match_lines": _placed(CORPUS, c.CUSTOM_RULES)
    + "SELECT path, rule_id, line_no, line_offset, start, len FROM placed",
    "line_offsets": "SELECT path, line_no, line_start AS start, strlen(line) AS len FROM ("
    + _line_table(f"SELECT path, 0 AS rule_id, content FROM ({CORPUS})")
    + ")",
    "safe_log": _placed(CORPUS, c.CUSTOM_RULES)
    + """SELECT path, rule_id, start, '  ' || label || ' match at line ' || line_no || ': ''[characters '
  || (line_offset + 1) || '-' || (line_offset + len) || ']''' AS message FROM placed""",
    "unsafe_log": _placed(CORPUS, DEFAULT_RULES)
    + """SELECT path, rule_id, start,
  CASE WHEN len > 100 THEN substr(text, 1, list_max([k FOR k IN range(24, 98) IF strlen(substr(text, 1, k)) <= 97]))
  || '...' ELSE text END AS shown FROM placed""",
    "log_headers": _hits(CORPUS, c.CUSTOM_RULES)
    + f"""SELECT path, rule_id, count(*) AS matches, 'Filter applied: '
  || ({_list(r.label for r in c.CUSTOM_RULES)})[rule_id] || ' pattern '''
  || ({_list(r.pattern for r in c.CUSTOM_RULES)})[rule_id] || ''' matched ' || count(*)
  || ' time(s) in ' || path AS message FROM hits GROUP BY path, rule_id""",
    "lines_grouped": _placed(CORPUS, ENTITY_RULES)
    + """SELECT path, rule_id, line_no, count(*) AS matches, string_agg('[characters '
  || (line_offset + 1) || '-' || (line_offset + len) || ']', '; ' ORDER BY start) AS shown
FROM placed GROUP BY path, rule_id, line_no""",
    "tree_dirs": _ancestors(CORPUS),
    "tree_lines": f"SELECT *, row_number() OVER (ORDER BY path, NOT is_dir) - 1 AS position FROM ({_tree(CORPUS)})",
    "tree_text": f"""SELECT bundle, {TREE_TEXT} AS tree
FROM ({_tree(CORPUS, "bundle,")}) GROUP BY bundle""",
    "path_order": f"""SELECT path, strlen(content) AS size, row_number() OVER (ORDER BY {FILE_ORDER}) - 1 AS position
FROM ({CORPUS})""",
    "sample_files": f"""WITH {_admitted(CORPUS)}
SELECT CAST(row_number() OVER (ORDER BY {FILE_ORDER}) - 1 AS INTEGER) AS position, path,
  CASE status WHEN 'text' THEN 'Text(' || strlen(content) || ' chars)'
  ELSE upper(status[1]) || status[2:] || ': ' || content END AS shown
FROM c0 ORDER BY {FILE_ORDER} LIMIT 5""",
    "md_sections": ALL_DONE
    + f"SELECT path, md5({MD_SECTION}) AS digest, strlen({MD_SECTION}) AS bytes FROM done",
    "xml_sections": ALL_DONE
    + f"SELECT path, md5({_xml_section()}) AS digest, strlen({_xml_section()}) AS bytes FROM done",
    "xml_escaped": ALL_DONE
    + "SELECT path, md5(s) AS digest, strlen(s) AS bytes FROM (SELECT path, "
    + _xml_section(_xml_text("path"), _xml_text("content"))
    + " AS s FROM done)",
    "json_records": ALL_DONE + f"SELECT path, {RECORD} AS record FROM done",
    "md_bundle": MD_DOCUMENTS + BUNDLES,
    "xml_bundle": XML_DOCUMENTS + BUNDLES,
    "json_bundle": JSON_DOCUMENTS + BUNDLES,
    "bundle_totals": _totals("bundle")
    + "SELECT bundle, files, bytes, (bytes * 13 + 39) // 40 AS tokens FROM totals",
    "document_totals": _totals("")
    + "SELECT files, bytes, (bytes * 13 + 39) // 40 AS tokens FROM totals",
    "document_parts": f"""{_rewritten(TOPS)},
pieces AS (SELECT DISTINCT top, 0 AS rank, [''] AS k, 0 AS leaf, {_lines(MARKDOWN_HEAD)} AS piece FROM done
  UNION ALL SELECT top, 1, [path], CAST(NOT is_dir AS INTEGER), line || chr(10) FROM ({_tree(TOPS, "top,")})
  UNION ALL SELECT DISTINCT top, 2, [''], 0, {_lines(MARKDOWN_TREE_END)} FROM done
  UNION ALL SELECT top, 3, {FILE_ORDER}, 0, {MD_SECTION} FROM done)
SELECT top, row_number() OVER (PARTITION BY top ORDER BY rank, k, leaf) - 1 AS position, md5(piece) AS digest FROM pieces""",
    "document_sink": f"""{_rewritten(CORPUS)},
whole AS (SELECT {_lines(MARKDOWN_HEAD)} || (SELECT {TREE_TEXT} FROM ({_tree(CORPUS)})) || chr(10)
  || {_lines(MARKDOWN_TREE_END)} || string_agg({MD_SECTION}, '' ORDER BY {FILE_ORDER}) AS text FROM done)
{LINES_OF_WHOLE}""",
    "json_sink": f"""{_rewritten(CORPUS)},
{JSON_WHOLE},
lines AS (SELECT string_split(text, chr(10)) AS l FROM whole),
trees AS (SELECT l, string_split(l[1] || chr(10) || l[2], chr(92) || 'n') AS t FROM lines)
SELECT 'tree' AS part, unnest(range(len(t) - 1)) AS position, md5(unnest(t[:-2])) AS digest FROM trees
UNION ALL SELECT 'files', unnest(range(len(l) - 1)), md5(unnest([t[-1]] || l[3:])) FROM trees""",
    "document_ranges": f"""{_rewritten(CORPUS)},
{JSON_WHOLE},
bytes AS MATERIALIZED (SELECT encode(text || chr(10)) AS b, strlen(text) + 1 AS total FROM whole),
ranges AS (SELECT doc_id, doc_id * 9973 % total AS start, coalesce(strlen(text), 0) % 5000 + 1 AS length
  FROM documents, bytes)
SELECT doc_id, start, length, md5(array_slice(b, start + 1, start + length)) AS digest FROM ranges, bytes""",
    "source_specs": SPECS,
    "size_literals": """SELECT doc_id, literal, CASE doc_id % 7 WHEN 0 THEN n_chars
  WHEN 1 THEN n_chars * 1024 WHEN 2 THEN n_chars * 1048576 WHEN 3 THEN n_chars * 1073741824 END AS bytes
FROM (SELECT doc_id, n_chars, ' ' || n_chars || (['', 'K', 'm', 'G', 'KB', ' M', 'x'])[doc_id % 7 + 1]
  AS literal FROM documents)""",
    "subpath": f"""SELECT path, strlen(content) AS size FROM ({CORPUS})
WHERE starts_with(path, 'docs/src1/')""",
    "vcs_dirs": """SELECT source || CASE lang WHEN 'fr' THEN '/.github/' ELSE '/' END || doc_id
  || CASE lang WHEN 'de' THEN '/.git' ELSE '' END AS path FROM documents WHERE lang <> 'en'""",
    "ref_select": REFS,
    "ref_symbolic": SYMBOLIC,
    "snapshot_diff": f"""{_rewritten(DOCS, c.CUSTOM_RULES)},
before AS (SELECT path, content FROM ({DOCS}) UNION ALL SELECT path, content FROM ({PAGES})),
after AS (SELECT path, content FROM done UNION ALL SELECT path, content FROM ({TURNS}))
SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'added'
  WHEN a.path IS NULL THEN 'removed' WHEN a.content = b.content THEN 'same' ELSE 'changed' END AS change
FROM before b FULL JOIN after a ON a.path = b.path""",
    "ignored": _ignored(),
    "ignored_by_name": BY_NAME,
    "unknown_rule_type": _rewritten(CORPUS, [c.TIMEOUT]) + DIGEST,
    "bad_pattern": _rewritten(CORPUS, [c.TIMEOUT])
    + """SELECT path, CASE WHEN bad THEN 'error' ELSE status END AS status, CASE WHEN NOT bad THEN md5(content) END AS digest
FROM (SELECT *, status = 'text' AND regexp_matches(path, '\\.(cfg|json)$') AS bad FROM done)""",
    "file_scan": f"SELECT path, strlen(content) AS size FROM ({DOCS})",
    "flat_scan": "SELECT 'flat/' || doc_id AS path, coalesce(strlen(text), 0) AS size FROM documents",
    "file_admission": f"""WITH {_admitted(NAMED)} SELECT path, strlen(given) AS size, status, reason,
  md5(content) AS digest FROM c0""",
    "file_pushdown": f"""SELECT path, strlen(content) AS size, md5(content) AS digest FROM ({DOCS})
WHERE starts_with(path, 'docs/src1/') AND strlen(content) >= 500 AND strlen(content) < 20000""",
    "file_contents": f"""WITH {_admitted(NAMED)} SELECT path, strlen(given) AS size, status, reason,
  md5(content) AS digest FROM c0""",
}
