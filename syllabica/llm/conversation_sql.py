"""The repair of conversations as SQL: a fold of each conversation's rows from the last to the first.

Four strings stand for the four states: nine digits of cost, then the letters so far.
"""

from __future__ import annotations


def _with(cost: str, letter: str, rest: str) -> str:
    return f"lpad(CAST(CAST(substr({rest}, 1, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || '{letter}' || substr({rest}, 10)"


#: The state after an inserted or relabelled row, by state from 1 to 4.
_MADE = (3, 3, 4, 3)
_KEPT = {1: {"s": 2, "u": 3}, 2: {"u": 3}, 3: {"a": 4}, 4: {"u": 3}}


def _step(state: int) -> str:
    more = "CASE WHEN code[1] = upper(code[1]) THEN 1 ELSE 0 END"
    kept = " ".join(f"WHEN lower(code[1]) = '{c}' THEN {_with(more, 'K', f'v[{to}]')}" for c, to in _KEPT[state].items())
    made = _with(f"2 + {more}", "R", f"v[{_MADE[state - 1]}]")
    return f"least(CASE {kept} END, CASE WHEN code[1] <> 'x' THEN {made} END, {_with('3', 'D', f'v[{state}]')})"


def _inserts(name: str) -> str:
    return "[" + ", ".join(f"least({name}[{i}], {_with('2', 'I', f'{name}[{to}]')})" for i, to in enumerate(_MADE, 1)) + "]"


_STEPS = "[" + ", ".join(_step(state) for state in range(1, 5)) + "]"
_FIRST = "['000000000', '000000004II', '000000002I', '000000000']"
_FOLD = (f"list_reduce(list_prepend({_FIRST}, codes), lambda v, code: list_transform(list_transform([{_STEPS}], "
         f"lambda a: {_inserts('a')}), lambda b: {_inserts('b')})[1])")
_CRC = ("xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)), "
        "lambda a, b: xor(a >> 8, crc[xor(a & 255, b) + 1])))")
_SAME = "IS NOT DISTINCT FROM"

SQL = f"""
WITH RECURSIVE bits AS (
  SELECT i, i AS v, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
), crcs AS (SELECT list(v ORDER BY i) AS crc FROM bits WHERE k = 8),
keyed AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), kinds AS (SELECT *, {_CRC} % 20 AS kind FROM keyed, crcs),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
         unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
         regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS last FROM damaged
), faults AS (
  SELECT *, CASE WHEN last = '' THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM numbered
), coded AS (
  SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x'
                 ELSE CASE WHEN fault = 'truncated' THEN upper(c) ELSE c END END AS code
  FROM (SELECT *, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END AS c FROM faults)
), figures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (i > 1 AND before[1] || role[1] NOT IN ('su', 'ua', 'au')) AS illegal,
         list([code] ORDER BY i DESC) AS codes FROM coded GROUP BY conv_id
), audits AS (SELECT * EXCLUDE (codes), {_FOLD}[1] AS best FROM figures),
letters AS (
  SELECT conv_id, unnest(string_split(substr(best, 10), '')) AS letter, unnest(range(length(best) - 9)) AS p FROM audits WHERE length(best) > 9
), placed AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i,
         count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv_id ORDER BY p) AS e FROM letters
), edits AS (
  SELECT p.conv_id, p.p, p.e, p.letter, c.role, CASE WHEN p.letter = 'I' THEN '' ELSE c.text END AS text,
         max(CASE WHEN p.e = 1 AND p.letter = 'K' AND c.role[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS system
  FROM placed p LEFT JOIN coded c ON p.conv_id {_SAME} c.conv_id AND p.i = c.i
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (e - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text,
                             chr(10) ORDER BY p) AS whole FROM edits WHERE letter <> 'D' GROUP BY conv_id
)
SELECT o.conv_id, coalesce(a.gaps, 0) AS gaps, coalesce(a.blank, 0) AS blank, coalesce(a.duplicate, 0) AS duplicate,
       coalesce(a.truncated, 0) AS truncated, coalesce(a.illegal, 0) AS illegal, CAST(coalesce(substr(a.best, 1, 9), '0') AS BIGINT) AS cost,
       coalesce(substr(a.best, 10), '') AS audit, sha256(coalesce(r.whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN audits a ON o.conv_id {_SAME} a.conv_id
LEFT JOIN repaired r ON o.conv_id {_SAME} r.conv_id"""
