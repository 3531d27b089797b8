"""SQL that gives the same rows as some of the queries."""

JACCARD = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
x AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
g AS (SELECT doc_id, n, pos, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s FROM x),
s AS (SELECT DISTINCT doc_id, s FROM g WHERE pos <= greatest(n - 4, 1)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * k >= 75 * (ca.n + cb.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS other FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a)
SELECT w.doc_id, coalesce(c.n, 0) AS n_shingles, coalesce(m.least, w.doc_id) AS component_id FROM w LEFT JOIN c ON c.doc_id = w.doc_id
LEFT JOIN (SELECT doc_id, min(other) AS least FROM r GROUP BY doc_id) m ON m.doc_id = w.doc_id
"""

SUBSTRING = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
x AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
k AS (SELECT doc_id, n, pos, word, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) AS h FROM x),
r AS (SELECT doc_id, pos FROM k WHERE pos <= n - 34 AND h IN (SELECT h FROM k WHERE pos <= n - 34 GROUP BY h HAVING count(*) > 1)),
c AS (SELECT k.doc_id, k.pos, k.word, max(r.pos) OVER (PARTITION BY k.doc_id ORDER BY k.pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM k LEFT JOIN r ON r.doc_id = k.doc_id AND r.pos = k.pos)
SELECT w.doc_id, len(w.ws) AS n_words, coalesce(t.n_removed, 0) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256 FROM w
LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY doc_id) t ON t.doc_id = w.doc_id
"""

# CRC-32 bit by bit, as the polynomial 0xEDB88320 has it: h is the checksum of the id's decimals modulo 6.
TRIE = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, count(*) AS own FROM t GROUP BY conv_id),
c AS (SELECT conv_id, own, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda r, b: list_reduce(list_prepend(xor(r, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END))) % 6 AS h FROM k),
g AS (SELECT c.*, least(c.h, coalesce(k.own, 0)) AS taken FROM c LEFT JOIN k ON k.conv_id = c.base),
r AS (SELECT g.conv_id, t.pos, t.role, t.text FROM g JOIN t ON t.conv_id = g.base AND t.pos < g.h UNION ALL SELECT g.conv_id, t.pos - g.h + g.taken, t.role, t.text FROM g JOIN t ON t.conv_id = g.conv_id AND t.pos >= g.h),
p AS (SELECT conv_id, pos + 1 AS depth, length(text) AS chars, sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, '' ORDER BY pos) OVER (PARTITION BY conv_id ORDER BY pos)) AS key FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM g),
z AS (SELECT conv_id, max(depth) AS turns FROM p GROUP BY conv_id),
n AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars FROM p GROUP BY key, depth),
up AS (SELECT n.key, n.depth, n.conv_id, n.n_convs, n.chars, q.key AS parent FROM n LEFT JOIN p q ON q.conv_id = n.conv_id AND q.depth = n.depth - 1),
ch AS (SELECT parent AS key, depth - 1 AS depth, count(*) AS n_children FROM up WHERE parent IS NOT NULL GROUP BY ALL),
s AS (SELECT q.key, q.depth, sum((n.n_convs - 1) * n.chars) AS saved, count(*) FILTER (WHERE ch.key IS NULL) AS leaves FROM n JOIN p q ON q.conv_id = n.conv_id AND q.depth <= n.depth LEFT JOIN ch ON ch.key = n.key AND ch.depth = n.depth GROUP BY ALL),
e AS (SELECT p.key, p.depth, sha256(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id)) AS ends FROM p JOIN z ON z.conv_id = p.conv_id AND z.turns = p.depth GROUP BY ALL)
SELECT up.conv_id, up.depth, o.conv_id AS parent_conv_id, up.n_convs, coalesce(ch.n_children, 0) AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM up LEFT JOIN n o ON o.key = up.parent AND o.depth = up.depth - 1 LEFT JOIN ch ON ch.key = up.key AND ch.depth = up.depth JOIN s ON s.key = up.key AND s.depth = up.depth LEFT JOIN e ON e.key = up.key AND e.depth = up.depth
"""
