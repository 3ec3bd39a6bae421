"""Fixture bindings (FIXTURES §3) written once, run on both engines.

Each binding is one ``SELECT`` in the SQL subset Spark and DuckDB share;
relations are written ``{name}``.  On Spark, ``binding(spark, d, name)``
runs it with ``spark.sql(text, name=DataFrame, ...)`` so Catalyst still
prunes and pushes filters into the parquet scans.  On DuckDB, ``with_()``
turns the bindings (and oracle-only CTEs registered with ``define``) into a
``WITH`` clause.  Bindings are glue that maps the driver tables onto the
pipeline's concepts; the operators under test are DataFrame code.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from docket.functions import codebooks as cb
from docket.sources.tables import TABLES, table

VOTE_ORD_SQL = ("l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, "
                "l_tax, l_returnflag, l_linestatus, l_shipdate")

_SHARED: dict[str, str] = {}      # bindings runnable on both engines
_ORACLE: dict[str, str] = {}      # DuckDB-only CTEs (oracle text of operators)
_REF = re.compile(r"(?<![\\][pP])\{([A-Za-z_]\w*)\}")  # not \p{L}-style classes


def shared(name: str, body: str) -> None:
    _SHARED[name] = body.strip()


def define(name: str, deps: tuple[str, ...] | None, body: str) -> None:
    """Register a DuckDB-only CTE; relations may be written plain or ``{x}``."""
    _ORACLE[name] = body.strip()


def _refs(body: str) -> list[str]:
    out = []
    for m in _REF.finditer(body):
        if m.group(1) not in out:
            out.append(m.group(1))
    return out


def _plain(body: str) -> str:
    return _REF.sub(lambda m: m.group(1), body)


def with_(*names: str) -> str:
    """DuckDB ``WITH`` clause holding ``names`` and all they depend on."""
    order: list[str] = []

    def deps_of(n: str) -> list[str]:
        body = _SHARED.get(n) or _ORACLE.get(n)
        if body is None:
            raise KeyError(f"unknown relation {n!r} in oracle SQL")
        refs = _refs(body)
        # oracle CTEs may also mention earlier CTEs without braces
        for other in list(_SHARED) + list(_ORACLE):
            if other != n and other not in refs and re.search(rf"\b{other}\b", body):
                refs.append(other)
        return [r for r in refs if r not in TABLES]

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in deps_of(n):
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS (\n{_plain(_SHARED.get(n) or _ORACLE[n])}\n)" for n in order]
    return "WITH " + ",\n".join(parts) + "\n"


def binding(spark: SparkSession, d: str, name: str, **frames: DataFrame) -> DataFrame:
    """Run a shared binding on Spark.  ``frames`` supplies relations that are
    operator outputs (e.g. ``cases=case_table(...)``)."""
    cache: dict[str, DataFrame] = dict(frames)

    def build(n: str) -> DataFrame:
        if n in cache:
            return cache[n]
        if n in TABLES:
            df = table(spark, d, n)
        elif n in _SHARED:
            body = _SHARED[n]
            args = {r: build(r) for r in _refs(body)}
            df = spark.sql(body, **args)
        else:
            raise KeyError(f"relation {n!r} must be passed in as a DataFrame")
        cache[n] = df
        return df

    return build(name)


# ---------------------------------------------------------------- cases / votes

shared("cases_base", """
SELECT o.o_orderkey AS case_ord,
       CAST(year(o.o_orderdate) AS STRING) || '-' || lpad(CAST(o.o_orderkey AS STRING), 8, '0') AS case_id,
       CAST(year(o.o_orderdate) AS INT) AS year,
       CASE WHEN o.o_orderkey % 50 = 0 THEN NULL
            ELSE CAST(300 + o.o_custkey % 300 AS STRING) || ' U.S. ' || CAST(o.o_orderkey AS STRING) END AS usCite,
       o.o_orderpriority AS chief,
       c.c_name || ' v. ' || o.o_orderstatus AS caseName,
       CAST(o.o_custkey % 260 AS INT) AS petitioner,
       CAST(c.c_nationkey AS INT) AS petitionerState,
       CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE CAST(o.o_custkey % 61 AS INT) END AS respondentState,
       CAST(o.o_orderkey % 40 AS INT) AS caseOrigin,
       CAST(o.o_orderkey % 60 AS INT) AS caseOriginState,
       CAST(o.o_orderkey % 16 AS INT) AS issueArea,
       CAST(o.o_orderkey % 9 AS INT) AS lawType,
       CAST(NULLIF(o.o_orderkey % 13, 0) AS INT) AS caseDisposition,
       o.o_custkey, o.o_totalprice
FROM {orders} o LEFT JOIN {customer} c ON o.o_custkey = c.c_custkey""")

shared("votes", f"""
SELECT cb.case_id AS caseIssuesId, cb.usCite, cb.chief, cb.caseName, cb.petitioner,
       cb.petitionerState, cb.respondentState, cb.caseOrigin, cb.caseOriginState, cb.issueArea,
       cb.lawType, s.s_name AS justiceName,
       CAST(CASE l.l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 WHEN 'N' THEN 8 END AS INT) AS vote,
       cb.caseDisposition,
       CAST(sum(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l.l_orderkey) AS INT) AS majVotes,
       CAST(sum(CASE WHEN l.l_returnflag = 'A' THEN 1 ELSE 0 END) OVER (PARTITION BY l.l_orderkey) AS INT) AS minVotes,
       {', '.join('l.' + c for c in VOTE_ORD_SQL.split(', '))}
FROM {{lineitem}} l LEFT JOIN {{supplier}} s ON l.l_suppkey = s.s_suppkey
JOIN {{cases_base}} cb ON l.l_orderkey = cb.case_ord""")

# Member code → bio file stem (slug of the member's name); every 10th code is
# left out of the book so unknown codes pass through unchanged.
shared("member_book", """
SELECT s.s_name AS code,
  CASE WHEN s.s_suppkey % 9 = 0 THEN 'Member_J_' ELSE 'Member_' END || substr(s.s_name, 10, 9) AS name
FROM {supplier} s
WHERE s.s_suppkey % 10 <> 0""")

# ---------------------------------------------------------------- justices / bios

_ABBR = list(cb.STATE_ABBREVIATIONS)
shared("state_abbr", "SELECT CAST(idx AS INT) AS idx, abbr FROM (VALUES "
       + ", ".join(f"({i}, '{a}')" for i, a in enumerate(_ABBR)) + ") AS t(idx, abbr)")

# Justice dimension (D3) from supplier ⋈ nation ⋈ region.  Every 9th name
# carries a full stop, which file-name slugs lose (quirk: such bios miss).
shared("justices", """
SELECT
  CASE WHEN s.s_suppkey % 9 = 0 THEN 'Member J. ' || substr(s.s_name, 10, 9)
       ELSE 'Member ' || substr(s.s_name, 10, 9) END AS name,
  s.s_suppkey AS member_ord,
  s.s_name AS code,
  CASE WHEN s.s_suppkey % 2 = 0 THEN '(born ' || CAST(1900 + s.s_suppkey % 90 AS STRING) || ')'
       ELSE '(' || CAST(1900 + s.s_suppkey % 90 AS STRING) || '–' || CAST(1990 + s.s_suppkey % 30 AS STRING) || ')'
  END AS birth_death,
  CASE WHEN s.s_suppkey % 4 = 0 THEN '' WHEN s.s_suppkey % 4 = 1 THEN n.n_name ELSE a.abbr END AS state,
  CASE WHEN s.s_suppkey % 11 = 0 THEN 'Chief Justice' ELSE 'Associate Justice' END AS position,
  CASE WHEN s.s_suppkey % 5 = 0 THEN ''
       ELSE 'March ' || CAST(1 + s.s_suppkey % 28 AS STRING) || ', ' || CAST(1950 + s.s_suppkey % 60 AS STRING)
            || ' (' || CAST(50 + s.s_suppkey % 40 AS STRING) || '–' || CAST(s.s_suppkey % 10 AS STRING) || ')'
            || CASE WHEN s.s_suppkey % 3 = 0 THEN ' [' || CAST(s.s_suppkey % 7 AS STRING) || ']' ELSE '' END
  END AS appointment_date,
  CASE WHEN s.s_suppkey % 6 = 0 THEN 'Recess appointment' ELSE '' END AS appointment_method,
  CASE WHEN s.s_suppkey % 8 = 0 THEN '' ELSE 'President of ' || r.r_name END AS nominated_by,
  CAST(1950 + s.s_suppkey % 60 AS STRING) || ' – '
    || CASE WHEN s.s_suppkey % 3 = 0 THEN 'Incumbent' ELSE CAST(1970 + s.s_suppkey % 50 AS STRING) || ' (Died)' END
    AS tenure_text
FROM {supplier} s
LEFT JOIN {nation} n ON s.s_nationkey = n.n_nationkey
LEFT JOIN {region} r ON n.n_regionkey = r.r_regionkey
LEFT JOIN {state_abbr} a ON a.idx = s.s_nationkey""")

# Raw biography text per member: intro, sections; the court section heading
# varies in case and wording, some bios have no headings at all.
shared("bios_raw", """
SELECT j.member_ord,
  replace(j.name, '.', '') AS raw_name,
  j.name AS name,
  CASE WHEN j.member_ord % 7 = 0 THEN
    j.name || ' was a member from ' || n.n_name || '.  ' || chr(10) || 'No sections here.   '
  ELSE
    j.name || ' was a member from ' || n.n_name || '.  ' || chr(10) || chr(10)
    || '=== Early life ===' || chr(10)
    || j.name || ' was born in ' || n.n_name || ', ' || r.r_name || '.   ' || chr(10) || chr(10) || chr(10)
    || '=== Career ===' || chr(10)
    || 'Worked in ' || r.r_name || ' with balance ' || CAST(CAST(floor(s.s_acctbal) AS BIGINT) AS STRING) || '. ' || chr(10)
    || CASE WHEN j.member_ord % 3 = 0 THEN '=== supreme court service ===' || chr(10)
            WHEN j.member_ord % 3 = 1 THEN '=== Nomination as Chief Justice ===' || chr(10)
            ELSE '=== Later life ===' || chr(10) END
    || 'Served until ' || CAST(1970 + j.member_ord % 50 AS STRING) || '.' || chr(10)
    || '=== Supreme Court tenure ===' || chr(10) || 'Tenure text.' || chr(10)
  END AS text
FROM {justices} j
JOIN {supplier} s ON s.s_suppkey = j.member_ord
LEFT JOIN {nation} n ON s.s_nationkey = n.n_nationkey
LEFT JOIN {region} r ON n.n_regionkey = r.r_regionkey""")

# ---------------------------------------------------------------- descriptions

# Filtered description files (D5): header, ==== rule, body.  Every 11th file
# has no rule line (dropped by the parser); every 17th has its id after the
# rule (ignored → dropped).
shared("desc_files", """
SELECT d.doc_id AS file_ord,
  CASE WHEN cb.usCite IS NULL THEN 'case_' || cb.case_id
       ELSE replace(cb.usCite, ' ', '_') END AS file_key,
  CASE
    WHEN d.doc_id % 11 = 0 THEN
      'Case ID: ' || cb.case_id || chr(10) || 'Citation: ' || coalesce(cb.usCite, '') || chr(10) || d.text
    WHEN d.doc_id % 17 = 0 THEN
      'Citation: ' || coalesce(cb.usCite, '') || chr(10) || repeat('=', 80) || chr(10)
      || 'Case ID: ' || cb.case_id || chr(10) || d.text
    ELSE
      'Case ID: ' || cb.case_id || chr(10) || 'Citation: ' || coalesce(cb.usCite, '') || chr(10)
      || 'Case Name: ' || cb.caseName || chr(10) || repeat('=', 80) || chr(10) || chr(10) || d.text || chr(10)
  END AS text
FROM {documents} d JOIN {cases_base} cb ON d.doc_id = cb.case_ord""")

# Processed-bio store: one file per member whose slug is the key; every 6th
# member's bio is missing.
shared("bio_files", """
SELECT member_ord,
  CASE WHEN member_ord % 9 = 0 THEN 'Member_J_' ELSE 'Member_' END || substr(code, 10, 9) AS key
FROM {justices} WHERE member_ord % 6 <> 5""")

# Description store keys (files present in the description folder).
shared("desc_keys", """
SELECT DISTINCT file_key FROM {desc_files}""")
