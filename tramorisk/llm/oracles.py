"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

#: One row for each row; one row of each group of equal texts stays.
_COPIES = r"""
WITH rows AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(body) AS text_sha256
FROM rows WINDOW same AS (PARTITION BY body)
"""

#: crc32 goes bit by bit over the decimal digits; nodes are lists of turns, and a subtree is what starts with its list.
_TRIE = r"""
WITH turns AS (
  SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(t ORDER BY pos) AS ts FROM turns GROUP BY conv_id),
bits AS (
  SELECT conv_id, ts, list_reduce(
    list_prepend(4294967295, flatten([[ord(c), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(CAST(conv_id AS VARCHAR), '')])),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS state
  FROM own),
held AS (SELECT conv_id, ts, conv_id - conv_id % 5 AS base, CAST(xor(state, 4294967295) % 9 AS BIGINT) AS h FROM bits),
built AS (
  SELECT a.conv_id, list_concat(coalesce(b.ts[1:a.h], []), a.ts[a.h + 1:]) AS ts
  FROM held a LEFT JOIN own b ON b.conv_id = a.base),
member AS (SELECT conv_id, ts, unnest(range(len(ts) + 1)) AS depth FROM built),
node AS (
  SELECT depth, ts[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(ts) = depth), '') AS ends,
         (count(*) - 1) * CASE WHEN depth > 0 THEN strlen(any_value(ts[depth].text)) ELSE 0 END AS saved
  FROM member GROUP BY depth, ts[1:depth]),
family AS (
  SELECT c.depth, c.conv_id, p.conv_id AS parent_conv_id
  FROM node c JOIN node p ON p.depth = c.depth - 1 AND p.path = c.path[1:c.depth - 1]),
children AS (SELECT depth - 1 AS depth, parent_conv_id AS conv_id, count(*) AS n FROM family GROUP BY ALL),
node2 AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM node n LEFT JOIN children c USING (depth, conv_id)),
above AS (SELECT path, saved, n_children, unnest(range(depth + 1)) AS up FROM node2),
subtree AS (
  SELECT up AS depth, path[1:up] AS path, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
  FROM above GROUP BY up, path[1:up])
SELECT n.conv_id, n.depth, f.parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, sha256(n.ends) AS ends_sha256
FROM node2 n JOIN subtree s USING (depth, path) LEFT JOIN family f ON f.depth = n.depth AND f.conv_id = n.conv_id
"""

ORACLE_SQL: dict[str, str] = {"op11_prefix_trie": _TRIE, "op12_exact_dedup": _COPIES}
