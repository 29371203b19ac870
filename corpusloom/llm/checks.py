"""DuckDB SQL that must give the same rows as the query of the same name.

Operators 2, 3, 5 and 11 need a trained classifier or a tokenizer, operator 9 the draws of its
rounding and operator 13 eigenvectors; tests hold them against brute force and round trips instead.
"""

from __future__ import annotations

from .shared import WORD

_CRC_BITS = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
_BASE62 = "'0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz'"


def _spans(kind: str, number: int, pattern: str, fits: str) -> str:
    """Leftmost matches that don't overlap: a match begins where the gaps and matches before it end."""
    return f"""SELECT doc_id, {number} AS k, '{kind}' AS kind, CAST(s AS BIGINT) AS s, CAST(s + length(m) AS BIGINT) AS e FROM (
  SELECT doc_id, m, list_sum([length(g) FOR g IN gaps[1:i]]) + coalesce(list_sum([length(x) FOR x IN ms[1:i - 1]]), 0) AS s
  FROM (SELECT doc_id, ms, gaps, unnest(ms) AS m, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS gaps FROM texts)))
WHERE {fits}"""


def _checksum(token: str) -> str:
    """CRC-32 of the characters between a four-letter prefix and the last six, as six base-62 digits."""
    step = "xor(c, CAST(ord(x) AS UBIGINT))"
    bits = step
    for name in "abdefghi":
        bits = f"list_transform([{bits}], lambda {name}: {_CRC_BITS.format(name)})[1]"
    crc = f"list_reduce(string_split(substr({token}, 5, length({token}) - 10), ''), lambda c, x: {bits}, 4294967295::UBIGINT)"
    digits = " || ".join(f"substr({_BASE62}, CAST((v // {62**p}) % 62 AS INTEGER) + 1, 1)" for p in range(5, -1, -1))
    return f"list_transform([xor({crc}, 4294967295::UBIGINT)], lambda v: {digits})[1]"


_ASSIGN = (
    r"(?i:password|passwd|secret|token|api_?key)[\"'']?\x20*[:=]\x20*[\"'']?[A-Za-z0-9+/_.=-]+"
)
_VALUE = r"^(?i:password|passwd|secret|token|api_?key)[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)$"

OP1 = f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({_spans("assign", 0, _ASSIGN, f"length(regexp_extract(m, '{_VALUE}', 1)) >= 6")}
UNION ALL {_spans("access", 1, "AKIA[A-Z0-9]+", "length(m) >= 20")}
UNION ALL {_spans("hex", 2, "[0-9a-f]+", "length(m) >= 24")}
UNION ALL {_spans("github", 3, "gh[pousr]_[A-Za-z0-9]+", f"length(m) = 40 AND right(m, 6) = {_checksum('m')}")}
UNION ALL {_spans("npm", 4, "npm_[A-Za-z0-9]+", f"length(m) = 40 AND right(m, 6) = {_checksum('m')}")}),
per_doc AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access,
  count(*) FILTER (k = 2) AS n_hex, count(*) FILTER (k > 2) AS n_checked,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k <= 2) AS base,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM found GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  coalesce(n_checked, 0) AS n_checked, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN per_doc USING (doc_id)"""

OP4 = """WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))]) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5"""

OP6 = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest FROM p),
w AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes)
  ELSE page_id END AS winner FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN winner = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN winner <> page_id THEN winner END AS refers_to FROM w"""

OP7 = f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
starts AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)),
firsts AS (SELECT h, min(doc_id) AS f FROM starts GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM starts JOIN firsts USING (h) WHERE doc_id > f),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY j) AS t
  FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

OP8 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
  ELSE [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] END) AS s FROM w),
sets AS (SELECT list_sort(s) AS s, min(doc_id) AS rep FROM s GROUP BY 1),
items AS (SELECT rep, len(s) AS n, unnest(s) AS x FROM sets),
both_ AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i
  FROM items AS a JOIN items AS b ON a.x = b.x AND a.rep < b.rep AND 10 * a.n >= 8 * b.n AND 10 * b.n >= 8 * a.n GROUP BY 1, 2),
links AS (SELECT a, b FROM both_ WHERE 100 * i >= 80 * (na + nb - i)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT rep AS a, rep AS b FROM sets WHERE len(s) > 0 UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
low AS (SELECT a AS rep, min(b) AS component FROM reach GROUP BY a),
place AS (SELECT s, component FROM sets JOIN low USING (rep))
SELECT doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id,
  doc_id = coalesce(component, doc_id) AS kept FROM s LEFT JOIN place ON place.s = list_sort(s.s)"""


OP10 = f"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS w FROM documents),
b AS (SELECT min(item_id) AS item_id, w FROM (
  SELECT item_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL) GROUP BY w),
dw AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
bw AS (SELECT item_id, least(len(w), 12) AS n, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM b),
hits AS (SELECT doc_id, item_id, dw.i - bw.i AS shift FROM dw JOIN bw USING (x) GROUP BY ALL HAVING count(*) >= ceil(0.8 * any_value(n) - 1e-9)),
laid AS (SELECT doc_id, item_id,
  [CASE WHEN shift + j >= 1 AND shift + j <= len(d.w) AND d.w[shift + j] = b.w[j] THEN 1 ELSE 0 END FOR j IN range(1, len(b.w) + 1)] AS e
  FROM hits JOIN d USING (doc_id) JOIN b USING (item_id)),
found AS (SELECT doc_id, item_id, max(list_sum(e)) AS matched FROM laid
  WHERE list_max([list_sum(e[j:j + 11]) FOR j IN range(1, greatest(len(e) - 11, 1) + 1)]) >= ceil(0.8 * least(len(e), 12) - 1e-9)
  GROUP BY doc_id, item_id),
per_doc AS (SELECT doc_id, count(*) AS n_items, max(matched) AS matched,
  arg_min(item_id, -matched * 1000000000 + item_id) AS best_item FROM found GROUP BY doc_id)
SELECT doc_id, n_items IS NOT NULL AS leaked, coalesce(n_items, 0) AS n_items, best_item,
  CAST(matched AS BIGINT) AS matched FROM documents LEFT JOIN per_doc USING (doc_id)"""



def _assigned(n: int) -> str:
    """Each part's nearest entry of codebook ``n``, the first one on ties, and its distance."""
    return f"""a{n} AS MATERIALIZED (SELECT rid, part, any_value(x) AS x, min(d * 256 + entry) % 256 AS entry, min(d * 256 + entry) // 256 AS d FROM (
  SELECT rid, p.part, x, entry, CAST(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(x, c)]) AS HUGEINT) AS d
  FROM p JOIN c{n} USING (part)) GROUP BY rid, part)"""


def _moved(n: int) -> str:
    """Codebook ``n + 1``: floor of the mean of what codebook ``n`` got; other entries stay."""
    return f"""c{n + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m, c) AS c FROM c{n} LEFT JOIN (
  SELECT part, entry, list((s - ((s % k) + k) % k) // k ORDER BY pos) AS m FROM (
    SELECT part, entry, pos, sum(v) AS s, count(*) AS k FROM (
      SELECT part, entry, unnest(x) AS v, unnest(range(len(x))) AS pos FROM a{n}) GROUP BY part, entry, pos) GROUP BY part, entry) USING (part, entry))"""


OP12 = f"""WITH v AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS rid FROM (
  SELECT vec_id, label, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))]) = 0)),
p AS MATERIALIZED (SELECT rid, part, v[part * len(v) // 4 + 1:(part + 1) * len(v) // 4] AS x FROM v, (SELECT unnest(range(4)) AS part)),
c0 AS (SELECT part, rid AS entry, x AS c FROM p WHERE rid < 256),
{", ".join(_assigned(n) + ", " + _moved(n) for n in range(4))}, {_assigned(4)},
done AS (SELECT rid, string_agg(printf('%02x', CAST(entry AS BIGINT)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY rid),
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c4)
SELECT vec_id, label, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM v JOIN done USING (rid), book"""

SQL: dict[str, str] = {
    "op1_secret_scan": OP1,
    "op4_top_k": OP4,
    "op6_web_archives": OP6,
    "op7_substring_dedup": OP7,
    "op8_near_duplicates": OP8,
    "op10_decontamination": OP10,
    "op12_vector_codes": OP12,
}
