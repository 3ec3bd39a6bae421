"""Queries for the string and date column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from docket.functions import strings as S
from docket.plans.bindings import binding, shared, with_
from docket.plans.registry import query
from docket.sources.tables import table

# RE2 spellings of the classes used by docket.functions.strings.
WS = r"[\t\n\x0B\f\r ]"
WORD = r"\p{L}\p{N}_"
SP = r"\t\n\x0B\f\r "


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


# Citation variants: valid, missing full stop, other reporter, empty, NULL.
shared("cites", """
SELECT case_ord,
  CASE case_ord % 5 WHEN 0 THEN usCite
                    WHEN 1 THEN replace(usCite, 'U.S. ', 'U.S ')
                    WHEN 2 THEN replace(usCite, 'U.S.', 'F.3d')
                    WHEN 3 THEN usCite || ' (1999)'
                    ELSE CASE WHEN case_ord % 10 = 4 THEN '' ELSE usCite END END AS cite
FROM {cases_base}""")

shared("api_errors", """
SELECT event_id,
  CASE event_id % 6 WHEN 0 THEN 'Error 429: Quota exceeded for metric'
                    WHEN 1 THEN 'HTTP 429 Too Many Requests'
                    WHEN 2 THEN 'status RESOURCE_EXHAUSTED'
                    WHEN 3 THEN 'You exceeded your current QUOTA'
                    WHEN 4 THEN 'connection reset by peer'
                    ELSE event_type || ' ' || props END AS message
FROM {events}""")

shared("id_variants", """
SELECT case_ord,
  CASE case_ord % 5 WHEN 0 THEN caseName WHEN 1 THEN substr(case_id, 1, 2)
                    WHEN 2 THEN ' ' || substr(case_id, 2, 3) ELSE case_id END AS raw_id
FROM {cases_base}""")

shared("bio_paths", """
SELECT member_ord,
  CASE member_ord % 3 WHEN 0 THEN 'data' || chr(92) || 'processed' || chr(92) || 'bios' || chr(92) || replace(name, ' ', '_') || '.txt'
                      WHEN 1 THEN '  data/processed/bios/' || replace(name, ' ', '_') || '.txt '
                      ELSE replace(name, ' ', '_') || '.txt' END AS path
FROM {justices}""")

shared("versioned_names", """
SELECT doc_id,
  'doc_' || CAST(doc_id AS STRING) ||
  CASE doc_id % 5 WHEN 0 THEN '_v' || CAST(doc_id % 10 AS STRING) || '.txt'
                  WHEN 1 THEN '-v' || CAST(doc_id % 7 AS STRING)
                  WHEN 2 THEN '_v.txt'
                  WHEN 3 THEN '_v12_v3.txt'
                  ELSE '.txt' END AS fname
FROM {documents}""")


@query("citation_to_url", sql=with_("cites") + f"""
SELECT case_ord, cite,
  CASE WHEN cite IS NULL OR regexp_extract(cite, '^(\\d+){WS}+U\\.S\\.?{WS}+(\\d+)', 1) = '' THEN NULL
       ELSE '{S.CITATION_URL_PREFIX}' || regexp_extract(cite, '^(\\d+){WS}+U\\.S\\.?{WS}+(\\d+)', 1) || '/'
            || regexp_extract(cite, '^(\\d+){WS}+U\\.S\\.?{WS}+(\\d+)', 2) || '/' END AS url
FROM cites""")
def q_citation_to_url(spark, d):
    c = binding(spark, d, "cites")
    return c.select("case_ord", "cite", S.citation_to_url(F.col("cite")).alias("url"))


@query("sanitize_citation", sql=with_("cites") + f"""
SELECT case_ord, cite,
  CASE WHEN cite IS NULL THEN 'unknown.txt'
       ELSE regexp_replace(regexp_replace(cite, '[^{WORD}{SP}.\\-]', '', 'g'), '{WS}+', '_', 'g') || '.txt'
  END AS file_name
FROM cites""")
def q_sanitize_citation(spark, d):
    c = binding(spark, d, "cites")
    return c.select("case_ord", "cite", S.sanitize_citation(F.col("cite")).alias("file_name"))


@query("sanitize_case_id", sql=with_("cases_base") + f"""
SELECT case_ord, regexp_replace(caseName, '[^{WORD}\\-.]', '_', 'g') || '.txt' AS file_name
FROM cases_base""")
def q_sanitize_case_id(spark, d):
    c = binding(spark, d, "cases_base")
    return c.select("case_ord", S.sanitize_case_id(F.col("caseName")).alias("file_name"))


def slug_sql(x: str) -> str:
    inner = strip_sql(f"regexp_replace({x}, '[^{WORD}{SP}\\-]', '', 'g')")
    return f"regexp_replace({inner}, '[\\-{SP}]+', '_', 'g')"


@query("slugify_name", sql=with_("justices") + f"""
SELECT member_ord, name, {slug_sql('name')} AS slug FROM justices""")
def q_slugify_name(spark, d):
    j = binding(spark, d, "justices")
    return j.select("member_ord", "name", S.slugify_name(F.col("name")).alias("slug"))


BIRTH_SQL = """CASE WHEN birth_death IS NULL THEN NULL
       WHEN strpos(birth_death, 'born') > 0 THEN nullif(regexp_extract(birth_death, 'born (\\d{4})', 1), '')
       ELSE nullif(regexp_extract(birth_death, '\\((\\d{4})', 1), '') END"""


@query("birth_year", sql=with_("justices") + f"""
SELECT member_ord, birth_death, {BIRTH_SQL} AS birth_year FROM justices""")
def q_birth_year(spark, d):
    j = binding(spark, d, "justices")
    return j.select("member_ord", "birth_death", S.birth_year(F.col("birth_death")).alias("birth_year"))


def date_notes_sql(x: str) -> str:
    a = f"regexp_replace({x}, '{WS}*\\([^)]*\\){WS}*', '', 'g')"
    b = f"regexp_replace({a}, '{WS}*\\[[^\\]]*\\]{WS}*', '', 'g')"
    return strip_sql(b)


@query("strip_date_notes", sql=with_("justices") + f"""
SELECT member_ord, {date_notes_sql('appointment_date')} AS clean_date FROM justices""")
def q_strip_date_notes(spark, d):
    j = binding(spark, d, "justices")
    return j.select("member_ord", S.strip_date_notes(F.col("appointment_date")).alias("clean_date"))


# --- biography text steps -------------------------------------------------

HEAD_RE = "(?m)^=== [^\\n]* ===$"
SECTION_RE = "(?i)=== [^\\n]*(?:Supreme Court|SCOTUS|Associate Justice|Chief Justice)[^\\n]*==="


def pos_sql(x: str, pattern: str) -> str:
    """1-based start of the first match, 0 if none (DuckDB)."""
    return (f"CASE WHEN regexp_matches({x}, '{pattern}') THEN "
            f"strpos({x}, regexp_extract({x}, '{pattern}', 0)) ELSE 0 END")


def drop_intro_sql(x: str) -> str:
    p = pos_sql(x, HEAD_RE)
    return f"CASE WHEN {p} > 0 THEN {strip_sql(f'substr({x}, {p})')} ELSE {x} END"


def truncate_sql(x: str) -> str:
    p = pos_sql(x, SECTION_RE)
    return f"CASE WHEN {p} > 0 THEN {strip_sql(f'substr({x}, 1, {p} - 1)')} ELSE {x} END"


def trailing_sql(x: str) -> str:
    return strip_sql(f"regexp_replace({x}, '(?m){WS}+$', '', 'g')")


@query("drop_intro", sql=with_("bios_raw") + f"""
SELECT member_ord, {drop_intro_sql('text')} AS text FROM bios_raw""")
def q_drop_intro(spark, d):
    b = binding(spark, d, "bios_raw")
    return b.select("member_ord", S.drop_intro(F.col("text")).alias("text"))


@query("truncate_at_section", sql=with_("bios_raw") + f"""
SELECT member_ord, {truncate_sql('text')} AS text FROM bios_raw""")
def q_truncate_at_section(spark, d):
    b = binding(spark, d, "bios_raw")
    return b.select("member_ord", S.truncate_at_section(F.col("text")).alias("text"))


@query("clean_trailing_ws", sql=with_("bios_raw") + f"""
SELECT member_ord, {trailing_sql('text')} AS text FROM bios_raw""")
def q_clean_trailing_ws(spark, d):
    b = binding(spark, d, "bios_raw")
    return b.select("member_ord", S.clean_trailing_ws(F.col("text")).alias("text"))


@query("collapse_blank", sql="""
SELECT doc_id, regexp_replace(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g') AS text
FROM documents""")
def q_collapse_blank(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", S.collapse_blank(F.col("text")).alias("text"))


def wc_sql(x: str) -> str:
    return f"CAST(coalesce(len(list_filter(regexp_split_to_array({x}, '{WS}+'), lambda t: t <> '')), 0) AS INT)"


@query("word_count", sql=f"""
SELECT doc_id, {wc_sql('text')} AS words, CAST(length(text) AS INT) AS chars FROM documents""")
def q_word_count(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", S.word_count(F.col("text")).alias("words"),
                    F.length("text").alias("chars"))


@query("error_class", sql=with_("api_errors") + """
SELECT event_id, coalesce(""" + " OR ".join(
    f"strpos(lower(message), '{p}') > 0" for p in S.QUOTA_PHRASES) + """, false) AS stop
FROM api_errors""")
def q_error_class(spark, d):
    e = binding(spark, d, "api_errors")
    return e.select("event_id", S.error_class(F.col("message")).alias("stop"))


@query("split_tenure", sql=with_("justices") + f"""
SELECT member_ord,
  CASE WHEN strpos(tenure_text, '–') > 0 THEN {strip_sql("split_part(tenure_text, '–', 1)")} ELSE '' END AS tenure_start,
  CASE WHEN strpos(tenure_text, '–') = 0 THEN ''
       WHEN strpos(e, '(') > 0 AND strpos(e, ')') > 0 THEN {strip_sql("substr(e, 1, strpos(e, '(') - 1)")}
       ELSE e END AS tenure_end,
  CASE WHEN strpos(tenure_text, '–') > 0 AND strpos(e, '(') > 0 AND strpos(e, ')') > 0
       THEN {strip_sql("substr(e, strpos(e, '(') + 1, greatest(strpos(e, ')') - strpos(e, '(') - 1, 0))")}
       ELSE '' END AS tenure_status
FROM (SELECT *, {strip_sql("substr(tenure_text, strpos(tenure_text, '–') + 1)")} AS e FROM justices) j""")
def q_split_tenure(spark, d):
    j = binding(spark, d, "justices")
    t = S.split_tenure(F.col("tenure_text"))
    return j.select("member_ord", t["tenure_start"].alias("tenure_start"),
                    t["tenure_end"].alias("tenure_end"), t["tenure_status"].alias("tenure_status"))


@query("normalize_path", sql=with_("bio_paths") + f"""
SELECT member_ord, replace({strip_sql('path')}, '\\', '/') AS norm_path,
  list_last(regexp_split_to_array(replace({strip_sql('path')}, '\\', '/'), '[/\\\\]')) AS base
FROM bio_paths""")
def q_normalize_path(spark, d):
    b = binding(spark, d, "bio_paths")
    n = S.normalize_path(F.col("path"))
    return b.select("member_ord", n.alias("norm_path"), S.basename(n).alias("base"))


@query("canonical_base", sql=with_("versioned_names") + """
SELECT doc_id, regexp_replace(regexp_replace(fname, '(?i)\\.txt$', ''), '[_\\-]v\\d+$', '') AS base
FROM versioned_names""")
def q_canonical_base(spark, d):
    v = binding(spark, d, "versioned_names")
    return v.select("doc_id", S.canonical_base(F.col("fname")).alias("base"))


@query("name_from_file", sql=with_("bio_paths") + """
SELECT member_ord, replace(replace(list_last(string_split(replace(path, '\\', '/'), '/')), '.txt', ''), '_', ' ')
  AS name FROM bio_paths""")
def q_name_from_file(spark, d):
    b = binding(spark, d, "bio_paths")
    return b.select("member_ord", S.name_from_file(S.basename(F.col("path"))).alias("name"))


@query("year_from_id", sql=with_("id_variants") + f"""
SELECT case_ord, coalesce(TRY_CAST({strip_sql('substr(raw_id, 1, 4)')} AS INTEGER), 0) AS year
FROM id_variants""")
def q_year_from_id(spark, d):
    v = binding(spark, d, "id_variants")
    return v.select("case_ord", S.year_from_id(F.col("raw_id")).alias("year"))


@query("year_from_text", sql=with_("justices") + """
SELECT member_ord, TRY_CAST(nullif(regexp_extract(appointment_date, '(\\d{4})', 1), '') AS INTEGER) AS year
FROM justices""")
def q_year_from_text(spark, d):
    j = binding(spark, d, "justices")
    return j.select("member_ord", S.year_from_text(F.col("appointment_date")).alias("year"))


@query("parse_long_date", sql=with_("justices") + f"""
SELECT member_ord, strftime(coalesce(try_strptime({date_notes_sql('appointment_date')}, '%B %d, %Y'),
                                     try_strptime({date_notes_sql('appointment_date')}, '%d %B %Y')), '%Y-%m-%d') AS d
FROM justices""")
def q_parse_long_date(spark, d):
    j = binding(spark, d, "justices")
    return j.select("member_ord", F.date_format(S.parse_long_date(S.strip_date_notes(F.col("appointment_date"))),
                                                "yyyy-MM-dd").alias("d"))


@query("truncate_to_budget", sql=f"""
SELECT doc_id, CASE WHEN length(text) + {1000 + len(S.PROMPT_SUFFIX) + 1} > 30000
  THEN substr(text, 1, {30000 - 1000 - 200}) || '{S.TRUNCATION_MARKER}' ELSE text END AS text
FROM documents""")
def q_truncate_to_budget(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", S.truncate_to_budget(F.col("text"), prompt_len=1000).alias("text"))
