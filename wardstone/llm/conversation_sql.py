"""DuckDB SQL for the trie and the repair of conversations, over prefixes and rows as lists and recursion have them."""

from __future__ import annotations

#: CRC-32 of an ASCII text, bit by bit: each character is mixed in, then eight shifts (-1).
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({}, ''), lambda k: [ascii(k)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"""


def _crc32(text: str) -> str:
    return _CRC.format(text)


TRIE_SQL = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, {_crc32("c::VARCHAR")} % 9 AS h, c - c % 5 AS b FROM (SELECT DISTINCT c FROM t)),
rebuilt AS (SELECT convs.c, 0 AS part, p, r, x FROM convs JOIN t ON t.c = convs.b AND p < h UNION ALL SELECT convs.c, 1, p, r, x FROM convs JOIN t ON t.c = convs.c AND p >= h),
paths AS (SELECT c, row_number() OVER w AS d, list({{'r': r, 'x': x}}) OVER w AS path FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY part, p)
          UNION ALL SELECT c, 0, []::STRUCT(r VARCHAR, x VARCHAR)[] FROM convs),
ended AS (SELECT *, d = max(d) OVER (PARTITION BY c) AS ends FROM paths),
nodes AS (SELECT d, path, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(strlen(path[d].x), 0) AS saved,
                 sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM ended GROUP BY d, path),
kids AS (SELECT path[1:d - 1] AS path, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
below AS (SELECT k AS d, path[1:k] AS path, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens
          FROM (SELECT unnest(range(nodes.d + 1)) AS k, nodes.path, CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END AS leaf, saved FROM nodes LEFT JOIN kids USING (d, path)) GROUP BY ALL)
SELECT nodes.conv_id, nodes.d AS depth, up.conv_id AS parent_conv_id, nodes.n_convs, coalesce(kids.n, 0) AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, nodes.ends_sha256
FROM nodes JOIN below USING (d, path) LEFT JOIN kids USING (d, path) LEFT JOIN nodes up ON up.d = nodes.d - 1 AND up.path = nodes.path[1:nodes.d - 1]"""

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _way(state: str, cost: str, letter: str, line: str | None = None) -> str:
    """What is left from ``state`` on (cost, audit, texts), with an edit before it."""
    texts = f"{state}.o" if line is None else f"CASE WHEN {state}.o = '' THEN {line} ELSE {line} || chr(10) || {state}.o END"
    return f"{{'k': {state}.k + {cost}, 'a': '{letter}' || {state}.a, 'o': {texts}}}"


def _least(*ways: str) -> str:
    return f"list_sort(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))[1]"


def _edited(q: int) -> str:
    """The cheapest edit of a row in state ``q`` (0: nothing yet, 1: after s, 2: after u, 3: after a)."""
    follow = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[q]
    stays, ways = "CASE f WHEN 't' THEN 5 ELSE 0 END", [_way(f"s{q}", "2", "D")]
    for initial, to in follow.items():
        ways.append(f"CASE WHEN f IN ('', 't') AND left(r, 1) = '{initial}' THEN {_way(f's{to}', stays, 'K', "(r || ':' || x)")} END")
        if initial != "s":
            role = {"u": "user", "a": "assistant"}[initial]
            ways.append(f"CASE WHEN f IN ('', 't') THEN {_way(f's{to}', f'1 + {stays}', 'R', f"('{role}:' || x)")} END")
    return _least(*ways)


_USER, _ASSISTANT = "'user:'", "'assistant:'"
REPAIR_SQL = f"""
WITH RECURSIVE raw AS (SELECT conv_id AS c, turn AS t, coalesce(role, ' ') AS r, coalesce(text, ' ') AS x,
                              {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations),
damaged AS (SELECT c, t, CASE k WHEN 4 THEN 'user' ELSE r END AS r, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(x, '[.!?]', '', 'g') ELSE x END AS x,
                   unnest(CASE k WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM raw),
placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY t NULLS FIRST, r, x, copy) AS i, rtrim(x, {_SPACE}) AS rest FROM damaged),
marked AS (SELECT c, t, r, x, i, CASE WHEN rest = '' THEN 'b' WHEN row_number() OVER (PARTITION BY c, r, x ORDER BY i) > 1 THEN 'd' WHEN right(rest, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS f,
                  lag(left(r, 1)) OVER (PARTITION BY c ORDER BY i) || left(r, 1) AS meets FROM placed),
counts AS (SELECT c, coalesce(max(t) - min(t) + 1 - count(DISTINCT t), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated,
                  count(*) FILTER (i > 1 AND meets NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM marked GROUP BY c),
left_to_pay AS (
  SELECT c, n + 1 AS i, {{'k': 0, 'a': '', 'o': ''}} AS s0, {{'k': 10, 'a': 'II', 'o': 'user:' || chr(10) || 'assistant:'}} AS s1, {{'k': 5, 'a': 'I', 'o': 'assistant:'}} AS s2, {{'k': 0, 'a': '', 'o': ''}} AS s3 FROM counts
  UNION ALL
  SELECT c, i, {_least("e0", _way("i2", "5", "I", _USER))}, {_least("e1", _way("i2", "5", "I", _USER))}, i2, i3
  FROM (SELECT c, i, e0, e1, {_least("e2", _way("e3", "5", "I", _ASSISTANT))} AS i2, {_least("e3", _way("e2", "5", "I", _USER))} AS i3
        FROM (SELECT m.c, m.i, {_edited(0)} AS e0, {_edited(1)} AS e1, {_edited(2)} AS e2, {_edited(3)} AS e3
              FROM left_to_pay p JOIN marked m ON m.c IS NOT DISTINCT FROM p.c AND m.i = p.i - 1) edits) closed)
SELECT v.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(p.s0.k, 0)::BIGINT AS cost, coalesce(p.s0.a, '') AS audit, sha256(coalesce(p.s0.o, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) v LEFT JOIN counts n ON n.c IS NOT DISTINCT FROM v.conv_id LEFT JOIN left_to_pay p ON p.c IS NOT DISTINCT FROM v.conv_id AND p.i = 1"""
