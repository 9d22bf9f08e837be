"""DuckDB SQL for the results of the operators that SQL can express."""

_W = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = rf"""
WITH rules(n, verdict, rhost, rpath) AS (VALUES
  (1, 'allow', 'org', '/'), (2, 'block', 'example.org', '/es/'), (3, 'block', 'example.org', '/en/1'),
  (4, 'allow', 'com', '/fr/'), (5, 'block', 'com', '/de/')),
split AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE NULL END AS rest FROM pages),
parts AS (
  SELECT page_id, row_number() OVER () AS rid,
    {_LOWER.format("coalesce(regexp_extract(rest, '^[^/?#]*'), '')")} AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM split),
fits AS (
  SELECT rid, rhost || rpath AS rule, verdict,
    row_number() OVER (PARTITION BY rid ORDER BY length(rhost || rpath) DESC, n) AS k
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT p.page_id, p.host, p.path, f.rule,
  coalesce(f.verdict, CASE
    WHEN regexp_matches(host, '(?s)^(ads|adserver)\.')
      OR regexp_matches(host, '(?s)^doubleclick\.net$|\.doubleclick\.net$')
      OR regexp_matches(path, '(?s)^/wp-login\.php|^/cgi-bin/|/phpmyadmin/') THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN fits f ON f.rid = p.rid AND f.k = 1
"""

_CONTROL = r"<\\*s>|<\\*/s>|\[\\*INST\]|\[\\*/INST\]|<\\*\|endoftext\|>"
OP5 = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(text) + len(regexp_extract_all(text, '{_CONTROL}'))
    + CASE WHEN role = 'assistant' THEN 7 ELSE 14 + length(role) END)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

#: CRC32 of the text goes byte by byte over a table made from the polynomial.
OP7 = r"""
WITH tab AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || list_transform(range(8), lambda x: 0::BIGINT),
      lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 8 AS size,
    ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS h,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '-')), 1, 15))::BIGINT AS k
  FROM documents),
crc AS (
  SELECT rid, xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM d, tab),
total AS (SELECT greatest(1.0, sum(size) / 24.0) AS target, max(size) AS top FROM d),
run AS (
  SELECT rid, doc_id, size, h, k, sum(size) OVER (ORDER BY h, k, doc_id NULLS FIRST, size, rid) - size AS before FROM d),
unit AS (SELECT *, min(before) OVER (PARTITION BY h) AS g_before, sum(size) OVER (PARTITION BY h) AS g_bytes FROM run),
placed AS (
  SELECT u.*, least(23, floor(CASE WHEN g_bytes <= greatest(top, floor(target / 64)) THEN g_before + g_bytes / 2 ELSE before + size / 2 END / target))::INTEGER AS shard
  FROM unit u, total)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY before) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM placed JOIN crc USING (rid)
"""

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP8 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, -9223372036854775808) AS id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT rid, doc_id, id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
keyed AS (SELECT *, {_LOWER.format(f"trim(line, {_WS})")} AS key FROM lines),
repeated AS (
  SELECT key, max(id) AS keep, count(DISTINCT id) AS n_docs FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT id) >= 5),
judged AS (SELECT k.*, r.n_docs, r.key IS NOT NULL AND k.id <> r.keep AS gone FROM keyed k LEFT JOIN repeated r ON r.key = k.key)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256, coalesce(max(n_docs), 0)::BIGINT AS most_docs
FROM judged GROUP BY rid
"""

#: Targets stop at three times a source's size; each round caps those that are above.
#: Source i of the order has weight 5, 2 or 1; a source is capped when 3 * size / weight
#: is below the common level, so the capped ones are a prefix of that order.
OP9 = rf"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_W}'))::BIGINT AS size,
    md5('mix-1:' || coalesce(doc_id::VARCHAR, '-')) AS key, md5(coalesce(text, '')) AS tie FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source)) - 1) % 3 + 1] AS w,
    row_number() OVER (ORDER BY source IS NULL, source) AS nth FROM src),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / w, nth) AS k,
    coalesce(sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / w, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(w) OVER (ORDER BY 3.0 * source_size / w, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w,
    sum(source_size) OVER () AS total FROM weighed WHERE source_size > 0),
level AS (
  SELECT max(k) AS k FROM ordered WHERE 3.0 * source_size / w <= (total - capped) / open_w),
lambda_ AS (
  SELECT (SELECT any_value(total) FROM ordered) AS total, coalesce((SELECT k FROM level), 0) AS k),
open_ AS (
  SELECT (any_value(l.total) - coalesce(sum(3 * source_size) FILTER (WHERE o.k <= l.k), 0)) / sum(w) FILTER (WHERE o.k > l.k) AS unit
  FROM ordered o, lambda_ l),
goal AS (
  SELECT s.source, s.source_size, s.nth, s.w,
    CASE WHEN s.source_size = 0 THEN 0.0 WHEN o.k <= l.k THEN 3.0 * s.source_size ELSE s.w * u.unit END AS target,
    s.source_size = 0 OR o.k <= l.k AS is_full, ceil(s.source_size / 16.0)::BIGINT AS blocks
  FROM weighed s LEFT JOIN ordered o ON o.nth = s.nth, lambda_ l, open_ u),
seats AS (SELECT round(coalesce(sum(target) FILTER (WHERE NOT is_full), 0) / 16)::BIGINT AS n FROM goal),
quotients AS (
  SELECT nth, a.a, target / (2 * a.a + 1) AS q FROM goal, LATERAL (SELECT unnest(range(0, 3 * blocks + 1)) AS a) a WHERE NOT is_full),
dealt AS (
  SELECT nth, a, (24 * r + n - 1) // n - 1 AS shard
  FROM (SELECT nth, a, row_number() OVER (ORDER BY q DESC, nth) AS r FROM quotients), seats WHERE r <= n),
won AS (SELECT nth, count(*) AS n FROM dealt GROUP BY nth),
quota AS (
  SELECT g.source, g.source_size, g.target, g.blocks, g.nth, g.is_full,
    CASE WHEN is_full THEN 3 * g.blocks ELSE least(3 * g.blocks, coalesce(won.n, 0)) END AS quota
  FROM goal g LEFT JOIN won ON won.nth = g.nth),
placed AS (
  SELECT d.doc_id, d.size, q.*, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.tie, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM docs d JOIN quota q ON d.source IS NOT DISTINCT FROM q.source),
mixed AS (
  SELECT *, ((quota // greatest(blocks, 1)) * size
    + greatest(0, least(start + size, (quota % greatest(blocks, 1)) * 16) - start))::BIGINT AS taken FROM placed)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN CASE WHEN is_full THEN (24 * (start // 16 + 1) - 1) // quota ELSE dealt.shard END END::INTEGER AS mix_shard
FROM mixed LEFT JOIN dealt ON dealt.nth = mixed.nth AND dealt.a = start // 16
"""

_ITEM_W = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP10 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ITEM_W}') AS ws FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item, ws, least(len(ws), 13) AS m
  FROM (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ITEM_W}') AS ws FROM benchmark) WHERE len(ws) > 0),
wins AS (
  SELECT DISTINCT item, m, array_to_string(list_slice(ws, i, i + m - 1), ' ') AS win
  FROM (SELECT *, unnest(range(1, len(ws) - m + 2)) AS i FROM b)),
lengths AS (SELECT DISTINCT m FROM wins),
spots AS (
  SELECT rid, m, pos, array_to_string(list_slice(ws, pos, pos + m - 1), ' ') AS win
  FROM (SELECT rid, ws, m, unnest(range(1, len(ws) - m + 2)) AS pos FROM d, lengths WHERE len(ws) >= m)),
hits AS (SELECT s.rid, s.m, s.pos, w.item FROM spots s JOIN wins w ON w.m = s.m AND w.win = s.win),
cover AS (SELECT rid, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT rid, unnest(range(pos, pos + m)) AS p FROM hits) GROUP BY rid),
items AS (SELECT rid, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN cover USING (rid) LEFT JOIN items USING (rid)
"""

_TURN_MARK = "md5(strlen(role) || ':' || role || text)"
#: Nodes are named by the md5s of all their turns; every node is told to all its ancestors on its smallest member's path.
OP12 = f"""
WITH tab AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || list_transform(range(8), lambda x: 0::BIGINT),
      lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
turns AS (
  SELECT conv_id, {_TURN_MARK} AS mark, length(text)::BIGINT AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr({_TURN_MARK}, 1, 30)) - 1 AS idx FROM said),
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
    xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), tab),
rebuilt AS (
  SELECT c.conv_id, 0 AS seg, idx, mark, chars FROM convs c JOIN turns b ON b.conv_id = c.base AND b.idx < c.h
  UNION ALL SELECT c.conv_id, 1, idx, mark, chars FROM convs c JOIN turns o ON o.conv_id = c.conv_id AND o.idx >= c.h),
paths AS (
  SELECT conv_id, chars, row_number() OVER w AS depth, string_agg(mark, '') OVER w AS node
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY seg, idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
lens AS (SELECT conv_id, max(depth) AS len FROM paths GROUP BY conv_id),
nodes AS (
  SELECT depth, node, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
    string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (WHERE len = depth) AS ends
  FROM paths p JOIN lens USING (conv_id) GROUP BY depth, node),
kids AS (SELECT depth - 1 AS depth, left(node, -32) AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2),
family AS (
  SELECT n.*, coalesce(k.n, 0) AS n_children, p.conv_id AS parent_conv_id FROM nodes n
  LEFT JOIN kids k ON k.depth = n.depth AND k.node = n.node
  LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.node = left(n.node, -32)),
told AS (
  SELECT a.depth, a.node, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.chars) AS saved_tokens
  FROM family f JOIN paths a ON a.conv_id = f.conv_id AND a.depth <= f.depth GROUP BY a.depth, a.node)
SELECT conv_id, f.depth::BIGINT AS depth, parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM family f JOIN told t ON t.depth = f.depth AND t.node = f.node
"""
