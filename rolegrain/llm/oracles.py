"""DuckDB SQL of the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

SUBSTRING_DEDUP = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
 k AS (SELECT r, unnest(range(greatest(len(w) - 34, 0))) AS k, w FROM d),
 h AS (SELECT r, k, count(*) OVER (PARTITION BY md5(array_to_string(w[k + 1 : k + 35], ' '))) > 1 AS seen FROM k),
 t AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
 m AS (SELECT t.r, word, p, max(CASE WHEN seen THEN p END) OVER (PARTITION BY t.r ORDER BY p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM t LEFT JOIN h ON t.r = h.r AND t.p = h.k),
 a AS (SELECT r, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (r)"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10"""


# Written out here, apart from the operator, so that a wrong pattern there doesn't agree with itself.
SECRET_KINDS = (
    ("assign", """(?i)(password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", "length(regexp_extract(piece, '{p}', 2)) >= 12", "regexp_extract(piece, '{p}', 2)"),
    ("access", "AKIA[A-Z0-9]+", "length(piece) >= 18", "piece"),
    ("hex", "[0-9a-f]+", "length(piece) >= 16", "piece"),
    ("live", "[A-Za-z0-9+/_=-]+", "length(piece) >= 20 AND regexp_matches(piece, '[0-9]') AND regexp_matches(piece, '[A-Za-z]') AND len(list_distinct(string_split(piece, ''))) >= 10", "piece"),
)


def _pieces(rank: int) -> str:
    """Spans of a kind: its matches fenced, the pieces' lengths added up, and those kept that pass."""
    kind, pattern, passes, value = SECRET_KINDS[rank]
    quoted = pattern.replace("'", "''")
    parts = f"string_split(regexp_replace(translate(t, chr(1), chr(2)), '{quoted}', chr(1) || '\\0' || chr(1), 'g'), chr(1))"
    return f"""SELECT r, '{kind}' AS kind, {rank} AS rank, e - length(piece) AS s, e, {value.format(p=quoted)} AS value FROM
 (SELECT r, piece, i, sum(length(piece)) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS e FROM (SELECT r, unnest({parts}) AS piece, unnest(range(len({parts}))) AS i FROM d WHERE regexp_matches(t, '{quoted}'))) WHERE i % 2 = 1 AND {passes.format(p=quoted)}"""


SECRET_SCAN = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, source AS owner, concat_ws('/', source, lang) AS repository FROM documents),
 f AS ({' UNION ALL '.join(map(_pieces, range(len(SECRET_KINDS))))}),
 c AS (SELECT * FROM f WHERE kind <> 'live' OR NOT EXISTS (SELECT 1 FROM f b WHERE b.r = f.r AND b.kind <> 'live' AND b.s < f.e AND f.s < b.e)),
 o AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT repository) AS repositories FROM c JOIN d USING (r) GROUP BY value),
 j AS (SELECT c.*, owners, repositories, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS span FROM c JOIN o USING (value)),
 a AS (SELECT r, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex, string_agg(span, ',' ORDER BY s, rank) FILTER (WHERE kind <> 'live') AS base,
  string_agg(span, ',' ORDER BY s, rank) FILTER (WHERE kind <> 'live' OR owners <= 2) AS spans, count(*) FILTER (WHERE owners <= 2) AS n_owner_specific, count(*) FILTER (WHERE owners > 2) AS n_widely_copied, max(repositories) AS most_repositories FROM j GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
 coalesce(n_owner_specific, 0) AS n_owner_specific, coalesce(n_widely_copied, 0) AS n_widely_copied, coalesce(most_repositories, 0) AS most_repositories FROM d LEFT JOIN a USING (r)"""

NGRAM_JACCARD = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
 s AS (SELECT DISTINCT r, md5(array_to_string(w[k + 1 : k + 4], ' ')) AS h FROM (SELECT r, w, unnest(range(greatest(len(w) - 3, 1))) AS k FROM d WHERE len(w) > 0)),
 n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
 p AS (SELECT a.r AS a, b.r AS b, count(*) AS shared FROM s a JOIN s b ON a.h = b.h AND a.r <> b.r GROUP BY ALL),
 l AS (SELECT a, b FROM p JOIN n x ON a = x.r JOIN n y ON b = y.r WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
 reach AS (SELECT r, r AS q FROM d UNION SELECT reach.r, l.b AS q FROM reach JOIN l ON reach.q = l.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(e.doc_id) AS component_id FROM d JOIN reach ON d.r = reach.r JOIN d e ON reach.q = e.r LEFT JOIN n ON n.r = d.r GROUP BY d.r, d.doc_id"""

#: crc32 of a decimal number, byte by byte and bit by bit.
_BIT = "xor(acc >> 1, 3988292384 * (acc & 1))"
_BYTE = f"list_reduce(list_prepend(xor(crc, byte), CAST(range(8) AS BIGINT[])), lambda acc, bit: {_BIT})"
CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda crc, byte: {_BYTE}), 4294967295)"

PREFIX_TRIE = f"""
WITH t AS (SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || length(coalesce(text, '')) || ':' || coalesce(text, '')) AS w, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
 o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, w) AS pos FROM t),
 c AS (SELECT conv_id, conv_id - conv_id % 100 AS block, {CRC} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
 r AS (SELECT c.conv_id, 0 AS part, pos, w, chars FROM c JOIN o ON o.conv_id = c.block AND pos <= h UNION ALL SELECT c.conv_id, 1, pos, w, chars FROM c JOIN o USING (conv_id) WHERE pos > h),
 d AS (SELECT conv_id, chars, row_number() OVER x AS depth, sha256(string_agg(w, '') OVER x) AS node FROM r WINDOW x AS (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING)),
 p AS (SELECT conv_id, depth, node, lag(node, 1, '') OVER (PARTITION BY conv_id ORDER BY depth) AS up, chars, lead(node) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS ends FROM d UNION ALL SELECT c.conv_id, 0, '', NULL, 0, c.conv_id NOT IN (SELECT conv_id FROM d) FROM c),
 n AS (SELECT node, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(up) AS up, any_value(chars) AS chars, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ids FROM p GROUP BY node),
 k AS (SELECT up AS node, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
 s AS (SELECT p.node, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves, CAST(sum((n_convs - 1) * n.chars) AS BIGINT) AS saved_tokens FROM n LEFT JOIN k USING (node) JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.node)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(n.ids) AS ends_sha256 FROM n JOIN s USING (node) LEFT JOIN k USING (node) LEFT JOIN n u ON u.node = n.up"""
