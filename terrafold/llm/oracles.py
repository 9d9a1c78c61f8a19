"""DuckDB SQL with the results of the queries of the same name."""

from collections.abc import Callable

from .quality_rules import STOP_WORDS

SQL: dict[str, str] = {}

SQL["op9_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS width, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, i, width, array_to_string(w[i:i + width - 1], ' ') AS g
  FROM (SELECT doc_id, w, width, unnest(generate_series(1, len(w) - width + 1)) AS i FROM d, (SELECT DISTINCT width FROM bw))),
hits AS (SELECT DISTINCT doc_id, i, dw.width AS width, item_id FROM dw JOIN bw USING (g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + width - 1)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

SQL["op7_substring_dedup"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d)),
least AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
hit AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS p FROM win JOIN least USING (g) WHERE doc_id > m),
gone AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""

SQL["op5_ngram_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s AS a JOIN s AS b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
reach AS (
  SELECT doc_id AS node, doc_id AS other FROM d
  UNION
  SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.node = d.doc_id GROUP BY d.doc_id
"""

_STOP_WORDS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))

SQL["op3_quality_rules"] = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d)),
twice AS (SELECT doc_id, g FROM win GROUP BY ALL HAVING count(*) > 1),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win JOIN twice USING (doc_id, g)) GROUP BY doc_id),
c AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(regexp_extract_all(text, '[!?]')) AS n_marks,
    len(list_filter(w, lambda x: lower(x) IN ({_STOP_WORDS}))) AS n_stop_words, len(lines) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * word_chars BETWEEN 200 * n_words AND 1500 * n_words AND 100 * n_symbols <= 10 * n_words
    AND 100 * n_marks <= 50 * n_words AND 100 * n_dup_lines <= 50 * n_lines AND 100 * n_stop_words >= n_words AS kept
FROM j
"""

SQL["op1_warc"] = r"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (payload_digest)
"""

SQL["op4_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turn_no FROM conversations),
c AS (
  SELECT conv_id, count(*) AS n, string_agg(coalesce(role, chr(3)) || chr(1) || coalesce(text, chr(3)) || chr(2), '' ORDER BY turn_no) AS s FROM t GROUP BY conv_id)
SELECT t.conv_id, turn_no, role, '<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS rendered
FROM t JOIN c AS a USING (conv_id)
WHERE NOT EXISTS (SELECT 1 FROM c AS b WHERE b.conv_id <> a.conv_id AND starts_with(b.s, a.s) AND (b.n > a.n OR b.conv_id < a.conv_id))
"""

SQL["op13_filter_interaction"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
first AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
label AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN d.doc_id > least THEN 'E' ELSE '' END AS failed
  FROM d JOIN first USING (text) LEFT JOIN label ON label.doc_id = d.doc_id),
h AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
o AS (
  SELECT '' AS filter_order
  UNION ALL
  SELECT filter_order || c FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) WHERE NOT contains(filter_order, c)),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS here, filter_order[1:step - 1] AS earlier FROM o, generate_series(1, 5) AS g(step) WHERE length(filter_order) = 5),
x AS (
  SELECT part, filter_order, step, here, n, good, toxic, contains(failed, here) AS fails, translate(failed, earlier, '') <> failed AS gone, failed = here AS only_here
  FROM h, s),
r AS (
  SELECT part, filter_order, step, here, CAST(coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (fails AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (only_here), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS BIGINT) AS toxic_lost
  FROM x GROUP BY ALL)
SELECT * EXCLUDE (here), CAST(sum(removed) OVER (PARTITION BY part, here) AS BIGINT) AS shapley FROM r
"""


def _more(value: str, cost: str, edit: str) -> str:
    """SQL for a (cost, audit), told as eight digits and the audit, after one more edit."""
    return f"printf('%08d', CAST({value}[1:8] AS BIGINT) + {cost}) || {value}[9:] || '{edit}'"


def _inserted(columns: str, table: str) -> str:
    """SQL that adds to the values v0 to v3 by last kind those which insertions lead to."""
    user = f"least(v2, {_more('v0', '3', 'I')}, {_more('v1', '3', 'I')}, {_more('v3', '3', 'I')})"
    return f"SELECT {columns}, v0, v1, w2 AS v2, least(v3, {_more('w2', '3', 'I')}) AS v3 FROM (SELECT *, {user} AS w2 FROM {table})"


def _before_user(more: Callable[[str], str]) -> str:
    return ", ".join(more(f"x.v{k}") for k in (0, 1, 3))


SQL["op11_chat_repair"] = rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
original AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS told
  FROM conversations),
kinds AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295, told), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS kind
  FROM original, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS r FROM damaged),
judged AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY r) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS broken, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY r) || role[1] AS pair
  FROM placed),
turns AS (SELECT *, blank OR again AS must_go, CASE WHEN broken THEN 3 ELSE 0 END AS charge FROM judged),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
    count(*) FILTER (NOT must_go AND broken) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(r) AS n
  FROM turns GROUP BY conv_id),
steps AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS r, '00000000' AS v0, CAST(NULL AS VARCHAR) AS v1, CAST(NULL AS VARCHAR) AS v2, CAST(NULL AS VARCHAR) AS v3 FROM counts
  UNION ALL
  SELECT t.conv_id, t.r, {_more('x.v0', '4', 'D')},
    CASE WHEN NOT must_go AND role[1] = 's' THEN least({_more('x.v1', '4', 'D')}, {_more('x.v0', 'charge', 'K')}) ELSE {_more('x.v1', '4', 'D')} END,
    CASE WHEN must_go THEN {_more('x.v2', '4', 'D')} WHEN role[1] = 'u' THEN least({_more('x.v2', '4', 'D')}, {_before_user(lambda v: _more(v, 'charge', 'K'))}, {_before_user(lambda v: _more(v, '3 + charge', 'R'))})
      ELSE least({_more('x.v2', '4', 'D')}, {_before_user(lambda v: _more(v, '3 + charge', 'R'))}) END,
    CASE WHEN must_go THEN {_more('x.v3', '4', 'D')} WHEN role[1] = 'a' THEN least({_more('x.v3', '4', 'D')}, {_more('x.v2', 'charge', 'K')}, {_more('x.v2', '3 + charge', 'R')})
      ELSE least({_more('x.v3', '4', 'D')}, {_more('x.v2', '3 + charge', 'R')}) END
  FROM ({_inserted('conv_id, r', 'steps')}) AS x JOIN turns AS t ON t.conv_id IS NOT DISTINCT FROM x.conv_id AND t.r = x.r + 1),
ends AS (
  SELECT x.conv_id, CAST(least(v0, v3)[1:8] AS BIGINT) AS cost, least(v0, v3)[9:] AS audit
  FROM ({_inserted('conv_id, r', 'steps')}) AS x JOIN counts ON counts.conv_id IS NOT DISTINCT FROM x.conv_id AND n = r),
edits AS (SELECT conv_id, audit, unnest(generate_series(1, length(audit))) AS i FROM ends),
lines AS (
  SELECT e.*, audit[i] AS edit, count(*) FILTER (audit[i] <> 'I') OVER (PARTITION BY conv_id ORDER BY i) AS r, count(*) FILTER (audit[i] <> 'D') OVER (PARTITION BY conv_id ORDER BY i) AS j FROM edits AS e),
kept AS (
  SELECT l.conv_id, i, edit, j, CASE WHEN edit = 'K' THEN role END AS role, CASE WHEN edit = 'I' THEN '' ELSE text END AS text
  FROM lines AS l LEFT JOIN turns AS t ON t.conv_id IS NOT DISTINCT FROM l.conv_id AND t.r = l.r WHERE edit <> 'D'),
named AS (SELECT *, max(CASE WHEN j = 1 AND role[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS system FROM kept),
told AS (
  SELECT conv_id, sha256(string_agg(coalesce(role, CASE WHEN (j - system) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY i)) AS repaired_sha256 FROM named GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS o
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM o.conv_id
"""
