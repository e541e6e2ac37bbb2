"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from embergrid.llm import quality_rules as _q

_BOILER = "|".join(_q.BOILERPLATE)

#: Words and windows of operator 1; its lines; its verdict.
_OP1 = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
x AS (SELECT r, unnest(range(1, greatest(len(ws) - 7, 0) + 1)) AS i, ws FROM w),
k AS (SELECT r, i, ws[i:i+7] AS win FROM x),
rep AS (SELECT r, i FROM k QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
cov AS (SELECT r, count(DISTINCT i + o) AS n FROM rep, (SELECT unnest(range(8)) AS o) GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS i FROM d),
m AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
  len(line) - len(replace(line, '|', '')) AS bars, len(regexp_extract_all(line, '[#*$%&<>]')) AS syms,
  len(regexp_extract_all(line, '[!?]')) AS shouts, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw, row_number() OVER (PARTITION BY r, line ORDER BY i) AS nth FROM l),
v AS (SELECT r, n, nth,
  nth > 1 OR (bars >= 3 AND 100 * bars > 25 * n) OR (syms >= 3 AND 100 * syms > 30 * n) OR (shouts >= 3 AND 100 * shouts > 30 * n)
  OR (n >= 60 AND NOT regexp_matches(line, '[.,;:!?…。、！？؟।]')) OR regexp_matches(lower(line), '{_BOILER}')
  OR (stut >= 5 AND 100 * stut > 40 * n) OR (n >= 3 AND len(regexp_extract_all(line, '[A-Z]')) > len(regexp_extract_all(line, '[a-z]'))) AS fails
  FROM (SELECT *, len(list_filter(range(2, len(lw) + 1), lambda i: lw[i] = lw[i - 1])) AS stut FROM m WHERE n > 0)),
s AS (SELECT r, count(*) FILTER (nth > 1) AS dup, count(*) FILTER (fails) AS failed, sum(n) FILTER (fails) AS lost FROM v GROUP BY r),
b AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(failed, 0) AS BIGINT) AS n_failed_lines, CAST(coalesce(lost, 0) AS BIGINT) AS n_lost_words
  FROM d JOIN w USING (r) LEFT JOIN cov USING (r) LEFT JOIN s USING (r))
SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * n_lost_words <= 50 * n_words AS kept FROM b
"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OP8 = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_WORD}') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_WORD}') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, array_to_string(ws[i:i+9], ' ') AS win, len(ws[i:i+9]) AS k FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, i, k, array_to_string(ws[i:i+k-1], ' ') AS win FROM (SELECT r, ws, k, unnest(range(1, greatest(len(ws) - k + 1, 0) + 1)) AS i FROM d, ks)),
h AS (SELECT r, i, dw.k AS k, item FROM dw JOIN bw USING (win) WHERE dw.k = bw.k),
n AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM h) GROUP BY r),
g AS (SELECT r, count(item) AS c, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(c, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN g USING (r)
"""

#: CRC-32 of a number's decimal text, bit by bit.
_CRC = """xor(list_reduce(list_transform(string_split(CAST({c} AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS UBIGINT)), lambda crc, ch:
 list_reduce(range(8), lambda r, i: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END), xor(crc, ch)), 4294967295::UBIGINT), 4294967295::UBIGINT)"""

_OP11 = f"""
WITH t AS (SELECT CAST(conv_id AS BIGINT) AS c, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS m, strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, m, bytes, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, m) - 1 AS pos FROM t),
c AS (SELECT c, c - c % 5 AS base, {_CRC.format(c="c")} % 9 AS h FROM (SELECT DISTINCT c FROM o)),
r AS (SELECT c.c, 1 AS src, pos, m, bytes FROM c JOIN o USING (c) WHERE pos >= h UNION ALL SELECT c.c, 0, pos, m, bytes FROM c JOIN o ON o.c = c.base WHERE pos < h),
s AS (SELECT c.c, coalesce(list(m ORDER BY src, pos) FILTER (m IS NOT NULL), []) AS ms, list(bytes ORDER BY src, pos) FILTER (m IS NOT NULL) AS bs FROM c LEFT JOIN r USING (c) GROUP BY 1),
p AS (SELECT c, d, len(ms) = d AS ends, array_to_string(ms[1:d], '') AS k, CASE WHEN d > 0 THEN array_to_string(ms[1:d - 1], '') END AS up, CASE WHEN d > 0 THEN bs[d] ELSE 0 END AS bytes FROM (SELECT *, unnest(range(len(ms) + 1)) AS d FROM s)),
n AS (SELECT k, d, any_value(up) AS up, any_value(bytes) AS bytes, count(*) AS n, min(c) AS c, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends) AS e FROM p GROUP BY 1, 2),
kids AS (SELECT up AS k, count(*) AS n FROM n WHERE up IS NOT NULL GROUP BY 1),
v AS (SELECT n.*, coalesce(kids.n, 0) AS kids FROM n LEFT JOIN kids USING (k)),
sub AS (SELECT a.k, count(*) FILTER (b.kids = 0) AS leaves, sum((b.n - 1) * b.bytes) AS saved FROM v a JOIN v b ON starts_with(b.k, a.k) GROUP BY 1)
SELECT v.c AS conv_id, v.d AS depth, w.c AS parent_conv_id, v.n AS n_convs, v.kids AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(v.e, '')) AS ends_sha256
FROM v JOIN sub USING (k) LEFT JOIN v w ON w.k = v.up
"""

_OP13 = r"""
WITH lab AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT d.*, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, {'A': len(ws) < 200, 'B': 100 * len(list_distinct(ws)) < 50 * len(ws), 'C': 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t),
  'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(doc_id > least, false)} AS x FROM w LEFT JOIN lab USING (doc_id)),
m AS (SELECT part, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda c: CASE c WHEN 'A' THEN x.A WHEN 'B' THEN x.B WHEN 'C' THEN x.C WHEN 'D' THEN x.D ELSE x.E END) AS fails FROM f),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS c, string_split(filter_order[:step - 1], '') AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, c, fails, good, toxic, list_contains(fails, c) AS bad, step > 1 AND list_has_any(fails, earlier) AS gone, n FROM (SELECT part, fails, good, toxic, count(*) AS n FROM m GROUP BY ALL), s),
g AS (SELECT part, filter_order, step, c, CAST(coalesce(sum(n) FILTER (NOT bad AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (bad AND NOT gone), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (bad AND gone), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (bad AND len(fails) = 1), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(n) FILTER (bad AND NOT gone AND good), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n) FILTER (bad AND NOT gone AND toxic), 0) AS BIGINT) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, c) AS BIGINT) AS shapley FROM g
"""

ORACLE: dict[str, str] = {"op1_quality_rules": _OP1, "op8_decontaminate": _OP8, "op11_prefix_trie": _OP11, "op13_filter_audit": _OP13}
