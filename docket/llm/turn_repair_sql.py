"""SQL of the repair query: the cheapest script as a fold over rows and states of the grammar, from the last row."""

from __future__ import annotations

#: The table entries of CRC-32 (reflected polynomial EDB88320) for the powers of two. The
#: checksum is linear, so the entry of any byte is the exclusive or of those of its bits.
_POWERS = [0x77073096, 0xEE0E612C, 0x076DC419, 0x0EDB8832, 0x1DB71064, 0x3B6E20C8, 0x76DC4190, 0xEDB88320]


def crc32_sql(data: str) -> str:
    """The unsigned crc32 of a list of bytes."""
    entry = "0"
    for k, power in enumerate(_POWERS):
        entry = f"xor({entry}, (((c & 255) >> {k}) & 1) * {power})"
    # the byte goes in first: c is then the register with its low byte mixed
    step = entry.replace("(c & 255)", "(xor(c, b) & 255)")
    return f"xor(list_reduce(list_prepend(4294967295, {data}), lambda c, b: xor(c >> 8, {step})), 4294967295)"


def _plus(cost: str, edit: str, rest: str) -> str:
    """A script is nine digits of cost and its audit, so that the least script is the least string."""
    return f"lpad((left({rest}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || {edit} || substr({rest}, 10)"


def _closed(s: str, y: str, p: str, q: str) -> str:
    """The states' scripts when up to two insertions may come first."""
    one, two = _plus("5", "'I'", q), _plus("10", "'II'", p)
    return f"least({s}, {one}, {two}) s, least({y}, {one}, {two}) y, least({p}, {one}) p, least({q}, {_plus('5', chr(39) + 'I' + chr(39), p)}) q"


def _stand(role: str, rest: str) -> str:
    return (f"CASE WHEN fault NOT IN ('blank', 'duplicate') THEN "
            f"{_plus(f'late + (initial <> {role})::INT', f'(CASE WHEN initial = {role} THEN {chr(39)}K{chr(39)} ELSE {chr(39)}R{chr(39)} END)', rest)} END")


_KEY = "(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))"
_WHITE = "(chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

REPAIR_SQL = f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql(f"list_transform(string_split({_KEY}, ''), lambda x: ascii(x)::BIGINT)")} % 20 AS kind
  FROM conversations),
live AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM keyed WHERE kind <> 0),
placed AS (
  SELECT conv_id, turn, role, text, rtrim(text, {_WHITE}) AS bare,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
         count(*) OVER (PARTITION BY conv_id) AS n FROM live),
judged AS (
  SELECT *, CASE WHEN role = '' THEN ' ' ELSE left(role, 1) END AS initial,
         CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed),
turns AS (
  SELECT *, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS late, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM judged),
scripts AS (
  SELECT conv_id, n + 1 AS i, {_closed("'000000000'", "NULL::VARCHAR", "'000000000'", "NULL::VARCHAR")}
  FROM (SELECT DISTINCT conv_id, n FROM turns)
  UNION ALL
  SELECT conv_id, i, {_closed('s', 'y', 'p', 'q')} FROM (
    SELECT t.conv_id, t.i,
           least({_plus('2', "'D'", 'z.s')}, {_stand("'u'", 'z.q')}, CASE WHEN initial = 's' THEN {_stand("'s'", 'z.y')} END) AS s,
           least({_plus('2', "'D'", 'z.y')}, {_stand("'u'", 'z.q')}) AS y,
           least({_plus('2', "'D'", 'z.p')}, {_stand("'u'", 'z.q')}) AS p,
           least({_plus('2', "'D'", 'z.q')}, {_stand("'a'", 'z.p')}) AS q
    FROM scripts z JOIN turns t ON t.conv_id IS NOT DISTINCT FROM z.conv_id AND t.i = z.i - 1)),
best AS (SELECT conv_id, left(s, 9)::BIGINT AS cost, substr(s, 10) AS audit FROM scripts WHERE i = 1),
edits AS (
  SELECT conv_id, audit[k:k] AS edit, k, len(replace(audit[:k], 'I', '')) AS i, len(replace(audit[:k], 'D', '')) AS o,
         len(replace(audit, 'D', '')) % 2 AS headed
  FROM (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS k FROM best)),
texts AS (
  SELECT e.conv_id, string_agg(
    CASE WHEN edit = 'K' THEN role WHEN (o - headed) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
    CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS repaired
  FROM edits e LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM e.conv_id AND t.i = e.i WHERE edit <> 'D' GROUP BY e.conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN texts ON texts.conv_id IS NOT DISTINCT FROM c.conv_id"""
