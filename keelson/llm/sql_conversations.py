"""DuckDB SQL of the queries on conversations, written from their contracts."""

from __future__ import annotations

#: crc32 of an ASCII string column, from a table made by the polynomial's rule.
_CRC = """crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
         lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)) AS t
)"""


def _crc(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda c: ord(c)::BIGINT)"
    return (
        f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), "
        "lambda r, b: xor(r >> 8, t[(xor(r, b) & 255) + 1])), 4294967295::BIGINT)"
    )


def _step(cost: str, keep: dict[int, int], q: int, free: int, name: str) -> str:
    """Cheapest of deleting, keeping and renaming a row in state q: (cost, audit, turns)."""
    ways = [f"{{'c': g[{q}].c + 3, 'a': 'D' || g[{q}].a, 't': g[{q}].t}}"]
    rename = f"{{'c': g[{free}].c + 2 + cut, 'a': 'R' || g[{free}].a, 't': list_concat(['{name}:' || body], g[{free}].t)}}"
    free_ways = [f"CASE WHEN NOT gone THEN {rename} END"]
    for klass, to in keep.items():
        kept = f"{{'c': g[{to}].c + cut, 'a': 'K' || g[{to}].a, 't': list_concat([who || ':' || body], g[{to}].t)}}"
        free_ways.append(f"CASE WHEN NOT gone AND klass = {klass} THEN {kept} END")
    return "list_min(list_filter([" + ", ".join(ways + free_ways) + "], lambda w: w IS NOT NULL))"


#: States 1 nothing, 2 after s, 3 after u, 4 after a; by class s 1, u 2, a 3 the state a kept row leads to.
_STATES = [
    ({1: 2, 2: 3}, 3, "user"), ({2: 3}, 3, "user"), ({3: 4}, 4, "assistant"), ({2: 3}, 3, "user"),
]
_ROWS = ", ".join(_step("c", keep, q, free, name) for q, (keep, free, name) in enumerate(_STATES, 1))


def _insert(given: str) -> str:
    """The better of not inserting and inserting one turn, then going on from ``given``."""
    ways = ", ".join(
        f"list_min([h[{q}], {{'c': {given}[{free}].c + 2, 'a': 'I' || {given}[{free}].a, "
        f"'t': list_concat(['{name}:'], {given}[{free}].t)}}])"
        for q, (_, free, name) in enumerate(_STATES, 1)
    )
    return f"[{ways}]"


_END = (
    "[{'c': 0, 'a': '', 't': []::VARCHAR[]}, {'c': 4, 'a': 'II', 't': ['user:', 'assistant:']}, "
    "{'c': 2, 'a': 'I', 't': ['assistant:']}, {'c': 0, 'a': '', 't': []::VARCHAR[]}]"
)
_SPACE = "[^\\x20\\x09-\\x0D]"

REPAIR = f"""
WITH RECURSIVE {_CRC}, hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS hit
  FROM conversations, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS who,
         CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS body,
         unnest(range(CASE hit WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hit WHERE hit <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, who, body) AS pos,
         NOT regexp_matches(body, '{_SPACE}') AS blank,
         CASE left(who, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 4 END AS klass,
         right(regexp_replace(body, '[\\x20\\x09-\\x0D]+$', ''), 1) NOT IN ('.', '!', '?') AS ends_open
  FROM damaged
), counted AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, who, body ORDER BY pos) AS occurrence FROM placed
), r AS (
  SELECT *, NOT blank AND occurrence > 1 AS duplicate, NOT blank AND occurrence = 1 AND ends_open AS truncated,
         blank OR occurrence > 1 AS gone, (NOT blank AND occurrence = 1 AND ends_open)::INT AS cut,
         lag(klass) OVER (PARTITION BY conv_id ORDER BY pos) AS before
  FROM counted
), stats AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
         count(*) FILTER (before IS NOT NULL AND NOT ((before, klass) IN ((1, 2), (2, 3), (3, 2)))) AS illegal
  FROM r GROUP BY conv_id
), dp AS (
  SELECT conv_id, n + 1 AS pos, {_END} AS g FROM stats
  UNION ALL
  SELECT conv_id, pos, {_insert("one")} AS g FROM (
    SELECT conv_id, pos, h, {_insert("h")} AS one FROM (
      SELECT r.conv_id, r.pos, [{_ROWS}] AS h FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.pos = dp.pos - 1
    )
  )
), best AS (
  SELECT conv_id, g[1].c AS cost, g[1].a AS audit, array_to_string(g[1].t, chr(10)) AS repaired FROM dp WHERE pos = 1
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
"""

TRIE = f"""
WITH {_CRC}, own AS (
  SELECT conv_id, md5(coalesce(role, '')) || md5(coalesce(text, '')) AS turn_key,
         len(regexp_extract_all(coalesce(text, ''), '{_SPACE}+')) AS words,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, {_crc("conv_id::VARCHAR")} % 4 AS h, conv_id - conv_id % 20 AS base
  FROM (SELECT DISTINCT conv_id FROM own), crc_table
), rebuilt AS (
  SELECT i.conv_id, 0 AS part, o.pos, o.turn_key, o.words FROM ids i JOIN own o ON o.conv_id = i.base AND o.pos <= i.h
  UNION ALL
  SELECT i.conv_id, 1, o.pos, o.turn_key, o.words FROM ids i JOIN own o ON o.conv_id = i.conv_id AND o.pos > i.h
), path AS (
  SELECT conv_id, 0 AS depth, '' AS node, NULL AS parent, 0 AS words FROM ids
  UNION ALL
  SELECT conv_id, depth, md5(keys), CASE WHEN depth = 1 THEN '' ELSE md5(left(keys, 64 * (depth::INT - 1))) END, words FROM (
    SELECT conv_id, words, row_number() OVER w AS depth, string_agg(turn_key, '') OVER w AS keys
    FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)
  )
), length AS (
  SELECT conv_id, max(depth) AS depth FROM path GROUP BY conv_id
), nodes AS (
  SELECT p.node, any_value(p.parent) AS parent, any_value(p.depth) AS depth, min(p.conv_id) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * any_value(p.words) AS saved,
         sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (p.depth = l.depth), '')) AS ends_sha256
  FROM path p JOIN length l ON l.conv_id = p.conv_id GROUP BY p.node
), branching AS (
  SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), subtree AS (
  SELECT a.node, count(*) FILTER (b.node IS NULL) AS n_leaves, sum(n.saved) AS saved_tokens
  FROM nodes n JOIN path a ON a.conv_id = n.conv_id AND a.depth <= n.depth LEFT JOIN branching b ON b.node = n.node GROUP BY a.node
)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(b.n_children, 0)::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN subtree s ON s.node = n.node LEFT JOIN branching b ON b.node = n.node LEFT JOIN nodes u ON u.node = n.parent
"""

ORACLES: dict[str, str] = {"op11_structure_repair": REPAIR, "op13_prefix_trie": TRIE}
