"""DuckDB queries that operators of this subpackage are held against."""

#: Links by counting shared n-grams of all pairs that share one; components by walking the links.
JACCARD_JOIN = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w
), u AS (
  SELECT doc_id, len(sh) AS n, hash(unnest(sh)) AS g FROM s
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u AS a JOIN u AS b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS doc, doc_id AS root FROM s UNION SELECT l.b, r.root FROM reach AS r JOIN links AS l ON r.doc = l.a
)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, component_id FROM s JOIN (SELECT doc, min(root) AS component_id FROM reach GROUP BY doc) ON doc = doc_id
"""

#: The cheapest edits from a conversation's last row back, a step a row, for the four states of the grammar: (cost, label) structs sort as weights do.
CONVERSATION_REPAIR = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS bytes
  FROM conversations
), coded AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b:
    list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 AS code FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM coded
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid FROM damaged
), faulty AS (
  SELECT *, left(role, 1) AS initial, CASE WHEN solid = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS previous FROM seen
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (previous || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faulty GROUP BY conv_id
), steps AS (
  SELECT conv_id, n AS place, {'c': 0::BIGINT, 'l': ''} AS s, {'c': 10::BIGINT, 'l': 'II'} AS y, {'c': 5::BIGINT, 'l': 'I'} AS u, {'c': 0::BIGINT, 'l': ''} AS a FROM counts
  UNION ALL
  SELECT conv_id, place - 1,
    list_sort([bs, {'c': bu.c + 5, 'l': 'I' || bu.l}, {'c': ba.c + 10, 'l': 'II' || ba.l}])[1],
    list_sort([by_, {'c': bu.c + 5, 'l': 'I' || bu.l}, {'c': ba.c + 10, 'l': 'II' || ba.l}])[1],
    list_sort([bu, {'c': ba.c + 5, 'l': 'I' || ba.l}])[1],
    list_sort([ba, {'c': bu.c + 5, 'l': 'I' || bu.l}])[1]
  FROM (
    SELECT conv_id, place,
      list_sort([{'c': s.c + 2, 'l': 'D' || s.l}] || CASE WHEN forced THEN [] ELSE [{'c': t + 1 + u.c, 'l': 'R' || u.l}] END || CASE WHEN NOT forced AND initial = 's' THEN [{'c': t + y.c, 'l': 'K' || y.l}] WHEN NOT forced AND initial = 'u' THEN [{'c': t + u.c, 'l': 'K' || u.l}] ELSE [] END)[1] AS bs,
      list_sort([{'c': y.c + 2, 'l': 'D' || y.l}] || CASE WHEN forced THEN [] ELSE [{'c': t + 1 + u.c, 'l': 'R' || u.l}] END || CASE WHEN NOT forced AND initial = 'u' THEN [{'c': t + u.c, 'l': 'K' || u.l}] ELSE [] END)[1] AS by_,
      list_sort([{'c': u.c + 2, 'l': 'D' || u.l}] || CASE WHEN forced THEN [] ELSE [{'c': t + 1 + a.c, 'l': 'R' || a.l}] END || CASE WHEN NOT forced AND initial = 'a' THEN [{'c': t + a.c, 'l': 'K' || a.l}] ELSE [] END)[1] AS bu,
      list_sort([{'c': a.c + 2, 'l': 'D' || a.l}] || CASE WHEN forced THEN [] ELSE [{'c': t + 1 + u.c, 'l': 'R' || u.l}] END || CASE WHEN NOT forced AND initial = 'u' THEN [{'c': t + u.c, 'l': 'K' || u.l}] ELSE [] END)[1] AS ba
    FROM (
      SELECT p.*, f.initial, f.fault IN ('blank', 'duplicate') AS forced, CASE f.fault WHEN 'truncated' THEN 5 ELSE 0 END AS t
      FROM steps AS p JOIN faulty AS f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND p.place = f.place
    )
  )
), best AS (
  SELECT conv_id, s.c AS cost, s.l AS audit FROM steps WHERE place = 0
), letters AS (
  SELECT conv_id, k, audit[k] AS edit, length(replace(audit[1:k], 'I', '')) AS place, length(replace(audit[k + 1:], 'D', '')) AS after FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS k FROM best)
), repaired AS (
  SELECT t.conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN f.role WHEN after % 2 = 0 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY k)) AS digest
  FROM letters AS t LEFT JOIN faulty AS f ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND t.place = f.place AND edit <> 'I' WHERE edit <> 'D' GROUP BY t.conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS o LEFT JOIN counts AS c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best AS b ON o.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN repaired AS r ON o.conv_id IS NOT DISTINCT FROM r.conv_id
"""
