"""DuckDB SQL for the training-data queries that SQL can express."""

OP6 = r"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 3),
dup AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) >= 2),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM dup, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w),
dl AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM ln WHERE regexp_matches(l, '[^ \x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(dl.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM w LEFT JOIN dl ON w.doc_id = dl.doc_id LEFT JOIN rep ON w.doc_id = rep.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (base_failed OR 10 * n_symbols > word_chars OR 10 * n_dup_lines > n_words) AS DOUBLE) AS k FROM f GROUP BY source),
g AS (SELECT sum(k) / sum(n) AS m, CAST(count(*) AS DOUBLE) AS hosts, sum(k * k / n) AS sq, sum(n) AS n, sum(n * n) AS nn FROM h),
v AS (SELECT *, CASE WHEN hosts > 1 THEN (sq - n * m * m - (hosts - 1) * m * (1 - m)) / (n - nn / n) ELSE 0 END AS between_var FROM g),
p AS (SELECT m, CASE WHEN hosts > 1 AND between_var > 0 THEN greatest(1.0, least(1000.0, m * (1 - m) / between_var - 1)) ELSE 1000.0 END AS s FROM v),
ok AS (SELECT source, (k + m * s) / (n + s) <= 0.5 AS host_ok FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND host_ok AS kept
FROM f JOIN ok ON f.source IS NOT DISTINCT FROM ok.source
"""

OP8 = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
d AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.keeper AS lost FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""

OP10 = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+')) AS BIGINT) AS size,
  (CAST(('0x' || substr(md5('mix' || chr(31) || coalesce(CAST(doc_id AS VARCHAR), '') || chr(31) || md5(coalesce(text, ''))), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656 AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
r AS (SELECT *, 3 * n AS cap, CASE r % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2 ELSE 1 END AS w, sum(n) OVER () AS total FROM s),
q AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM r),
l AS (SELECT arg_min(lv, cap / w) AS level FROM q WHERE lv * w <= cap),
t AS (SELECT source, n, least(cap, coalesce(level * w, cap)) AS target FROM r LEFT JOIN l ON TRUE WHERE n > 0),
b AS (SELECT *, length(bin(size)) AS bits FROM d),
c AS (SELECT source, bits, sum(size) AS words FROM b WHERE size > 0 GROUP BY source, bits),
v AS (SELECT c.*, n, target, (target - coalesce(sum(3 * words) OVER (PARTITION BY c.source ORDER BY bits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(bits * words) OVER (PARTITION BY c.source ORDER BY bits DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, least(3::DOUBLE, coalesce(arg_max(lv, bits) FILTER (lv * bits <= 3) OVER (PARTITION BY source) * bits, 3)) AS copies FROM v),
y AS (SELECT *, CAST(floor(copies + 1e-9::DOUBLE) AS BIGINT) AS whole, greatest(0, copies - floor(copies + 1e-9::DOUBLE)) AS p FROM x),
z AS (SELECT *, target - CAST(sum(whole * words) OVER (PARTITION BY source) AS DOUBLE) AS rest FROM y),
j AS (SELECT b.*, z.n AS total, target, whole, p, rest, CASE WHEN p > 0 THEN u / (1 - u) / (p / (1 - p)) END AS q FROM b LEFT JOIN z ON b.source IS NOT DISTINCT FROM z.source AND b.bits = z.bits AND b.size > 0),
o AS (SELECT *, sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, u, size ROWS UNBOUNDED PRECEDING) AS run FROM j)
SELECT o.doc_id, size, CAST(coalesce(t.n, 0) AS BIGINT) AS source_size, coalesce(t.target, 0) AS target,
  CAST(CASE WHEN size > 0 THEN size * (whole + CASE WHEN q IS NOT NULL AND run - size / 2 <= rest THEN 1 ELSE 0 END) ELSE 0 END AS BIGINT) AS taken
FROM o LEFT JOIN t ON o.source IS NOT DISTINCT FROM t.source
"""


def _crc32(value: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a value as ASCII text: its bits, least first, through the reflected polynomial."""
    bits = f"flatten(list_transform(string_split(CAST({value} AS VARCHAR), ''), lambda c: list_transform(range(8), lambda k: CAST((ascii(c) >> CAST(k AS INT)) & 1 AS BIGINT))))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bits}), lambda r, b: xor(r >> 1, 3988292384 * (xor(r, b) & 1))), 4294967295)"


OP11 = rf"""
WITH t AS (SELECT conv_id AS c, turn, md5(md5(coalesce(role, '')) || md5(coalesce(text, ''))) AS d, len(regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, d) - 1 AS pos FROM t),
k AS (SELECT c, c - c % 20 AS base, {_crc32("c")} % 4 AS h FROM (SELECT DISTINCT c FROM t)),
m AS (SELECT k.c, 0 AS part, pos, d, w FROM k JOIN o ON k.base = o.c WHERE pos < h UNION ALL SELECT k.c, 1, pos, d, w FROM k JOIN o ON k.c = o.c WHERE pos >= h),
s AS (SELECT c, w, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS depth, md5(string_agg(d, '') OVER (PARTITION BY c ORDER BY part, pos)) AS node FROM m),
p AS (SELECT c, depth, node, lag(node, 1, '') OVER (PARTITION BY c ORDER BY depth) AS up, w FROM s UNION ALL SELECT c, 0, '', NULL, 0 FROM k),
l AS (SELECT c, max_by(node, depth) AS node FROM p GROUP BY c),
e AS (SELECT node, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ends FROM l GROUP BY node),
n AS (SELECT node, any_value(up) AS up, any_value(depth) AS depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS own FROM p GROUP BY node),
ch AS (SELECT up, count(*) AS n FROM n GROUP BY up),
f AS (SELECT n.*, coalesce(ch.n, 0) AS n_children FROM n LEFT JOIN ch ON n.node = ch.up),
b AS (SELECT DISTINCT x.node AS top, y.node FROM p x JOIN p y ON x.c = y.c AND y.depth >= x.depth),
g AS (SELECT top, sum(own) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM b JOIN f USING (node) GROUP BY top)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(g.leaves AS BIGINT) AS n_leaves, CAST(g.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ends, '')) AS ends_sha256
FROM f JOIN g ON f.node = g.top LEFT JOIN f u ON f.up = u.node LEFT JOIN e ON f.node = e.node
"""

OP12 = rf"""
WITH s AS (SELECT doc_id, {_crc32("doc_id")} AS h, regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+') AS w FROM documents),
a AS (SELECT *, h // 10 AS g, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM s),
p AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[CAST(CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END AS BIGINT) + 1]) END AS w FROM a),
w AS (SELECT doc_id, n, unnest(w) AS w, unnest(range(n)) AS i FROM p),
m AS (SELECT x.doc_id, x.i, x.i - y.i AS q FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i < x.i AND 4 * (x.i - y.i) <= x.n),
z AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m),
r AS (SELECT doc_id, q, min(i) - q AS b, count(*) + q AS len FROM z GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
u AS (SELECT doc_id, b, len, min(q) AS q FROM r GROUP BY doc_id, b, len),
best AS (SELECT doc_id, b, len, q FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(len AS DOUBLE) / q DESC, b, q) = 1),
d AS (SELECT doc_id, count(*) AS n_runs, string_agg(b || ',' || len || ',' || q || chr(10), '' ORDER BY b, q) AS runs FROM u GROUP BY doc_id),
lost AS (SELECT DISTINCT doc_id, unnest(range(b + q, b + len)) AS i FROM u),
k AS (SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.i) AS t FROM w LEFT JOIN lost ON w.doc_id = lost.doc_id AND w.i = lost.i WHERE lost.i IS NULL GROUP BY w.doc_id)
SELECT s.doc_id, coalesce(d.n_runs, 0) AS n_runs, best.b AS start, CAST(best.len AS BIGINT) AS length, best.q AS period, CAST(1000 * best.len // best.q AS BIGINT) AS exponent_milli,
  sha256(coalesce(d.runs, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM s LEFT JOIN d ON s.doc_id = d.doc_id LEFT JOIN best ON s.doc_id = best.doc_id LEFT JOIN k ON s.doc_id = k.doc_id
"""
