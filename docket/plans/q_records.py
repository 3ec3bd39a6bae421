"""Queries for decodes, text composites, record assembly and key joins
(SURVEY §2.2-2.3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docket.functions import codebooks as cb
from docket.functions import strings as S
from docket.operators import decode, records, text
from docket.plans.bindings import binding, define, shared, with_
from docket.plans.q_cases import case_table
from docket.plans.q_strings import BIRTH_SQL, WS, date_notes_sql, strip_sql, trailing_sql, wc_sql
from docket.plans.registry import query

# ---------------------------------------------------------------- SQL books

define("book_petitioner", None, cb.book_values_sql(cb.PETITIONER_CODES))
define("book_state", None, cb.book_values_sql(cb.STATE_CODES))
define("book_origin", None, cb.book_values_sql(cb.CASE_ORIGIN_CODES))
define("book_issue", None, cb.book_values_sql(cb.ISSUE_AREA_CODES))
define("book_abbr", None, cb.book_values_sql(cb.STATE_ABBREVIATIONS, "VARCHAR").replace("code", "abbr")
       .replace("label", "name"))
define("book_names", None, cb.book_values_sql(cb.NAME_CORRECTIONS, "VARCHAR").replace("code", "cname")
       .replace("label", "title"))

# Raw code columns as text: '27.0'-style floats, junk, NULL and plain ints.
shared("raw_codes", """
SELECT case_ord,
  CASE case_ord % 6 WHEN 0 THEN CAST(petitioner AS STRING) || '.0' WHEN 1 THEN 'x'
                    WHEN 2 THEN NULL ELSE CAST(petitioner AS STRING) END AS petitioner,
  CAST(petitionerState AS STRING) AS petitionerState,
  CAST(respondentState AS STRING) AS respondentState,
  CASE WHEN case_ord % 4 = 0 THEN '1e1' ELSE CAST(caseOrigin + 280 * (case_ord % 2) AS STRING) END AS caseOrigin,
  CAST(caseOriginState AS STRING) AS caseOriginState,
  CAST(issueArea AS STRING) AS issueArea
FROM {cases_base}""")

# Names: every 20th member carries a name from the override list.
shared("named_members", """
SELECT member_ord,
  CASE member_ord % 20 WHEN 0 THEN 'Byron White' WHEN 5 THEN 'William O. Douglas'
                       WHEN 10 THEN 'John Marshall Harlan II' ELSE name END AS name
FROM {justices}""")


def code_sql(x: str) -> str:
    d = f"TRY_CAST({x} AS DOUBLE)"
    return f"CASE WHEN {d} IS NOT NULL AND NOT isnan({d}) AND abs({d}) < 2.0e9 THEN CAST(trunc({d}) AS INTEGER) END"


def decode_sql(x: str, book: str, default: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN 'Not specified' ELSE coalesce((SELECT label FROM {book} b "
            f"WHERE b.code = {code_sql(x)}), '{default}') END")


DECODES = [("petitioner", "book_petitioner", "Unknown petitioner", "petitioner_label"),
           ("petitionerState", "book_state", "Unknown state", "petitioner_state_label"),
           ("respondentState", "book_state", "Unknown state", "respondent_state_label"),
           ("caseOrigin", "book_origin", "Unknown court", "origin_label"),
           ("caseOriginState", "book_state", "Unknown state", "origin_state_label"),
           ("issueArea", "book_issue", "Unknown issue area", "issue_label")]
SPARK_BOOK = {"book_petitioner": "petitioner", "book_state": "state", "book_origin": "origin",
              "book_issue": "issue_area"}


def decode_all(spark, df, decodes=DECODES, defaults: dict | None = None):
    for col, book, default, out in decodes:
        dflt = (defaults or {}).get(out, default)
        df = decode.decode_codes(df, col, cb.book_df(spark, cb.BOOKS[SPARK_BOOK[book]]), dflt, out)
    return df


@query("decode_codes", sql=with_("raw_codes", "book_petitioner", "book_state", "book_origin", "book_issue") + """
SELECT case_ord, """ + ",\n".join(f"{decode_sql(c, b, d)} AS {o}" for c, b, d, o in DECODES) + """
FROM raw_codes""")
def q_decode_codes(spark, d):
    r = binding(spark, d, "raw_codes")
    return decode_all(spark, r).select("case_ord", *[o for *_, o in DECODES])


@query("disposition_outcome", sql=with_("cases_base") + """
SELECT case_ord, caseDisposition,
  CASE WHEN caseDisposition IN (1,3,4,5,6,7,8) THEN 'in favour' WHEN caseDisposition IN (2,9) THEN 'against'
       ELSE 'unclear' END AS outcome
FROM cases_base""")
def q_disposition_outcome(spark, d):
    from docket.operators.tally import disposition_outcome
    c = binding(spark, d, "cases_base")
    return c.select("case_ord", "caseDisposition", disposition_outcome(F.col("caseDisposition")).alias("outcome"))


# Per-order majority/minority counts straight from lineitem (partial
# aggregation map-side, one row per order shuffled).
shared("order_counts", """
SELECT cb.case_ord, cb.caseDisposition, CAST(k.maj AS INT) AS majVotes, CAST(k.mnr AS INT) AS minVotes
FROM {cases_base} cb JOIN (
  SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS maj,
         sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS mnr
  FROM {lineitem} GROUP BY l_orderkey) k ON k.l_orderkey = cb.case_ord""")


@query("vote_shares", sql=with_("order_counts") + """
SELECT case_ord,
  CAST(CASE WHEN o = 'W' THEN majVotes WHEN o = 'L' THEN minVotes ELSE -1 END AS INT) AS votes_in_favor,
  CAST(CASE WHEN o = 'W' THEN minVotes WHEN o = 'L' THEN majVotes ELSE -1 END AS INT) AS votes_against,
  CAST(CASE WHEN o IS NOT NULL THEN 9 - majVotes - minVotes ELSE -1 END AS INT) AS votes_absent,
  CASE o WHEN 'W' THEN majVotes / 9.0 WHEN 'L' THEN minVotes / 9.0 ELSE -1.0 END AS pct_in_favor,
  CASE o WHEN 'W' THEN minVotes / 9.0 WHEN 'L' THEN majVotes / 9.0 ELSE -1.0 END AS pct_against,
  CASE WHEN o IS NOT NULL THEN (9 - majVotes - minVotes) / 9.0 ELSE -1.0 END AS pct_absent
FROM (SELECT *, CASE WHEN caseDisposition IN (1,3,4,5,6,7,8) THEN 'W' WHEN caseDisposition IN (2,9) THEN 'L' END AS o
      FROM order_counts) t""")
def q_vote_shares(spark, d):
    from docket.operators.tally import vote_counts
    c = binding(spark, d, "order_counts")
    v = vote_counts(F.col("caseDisposition"), F.col("majVotes"), F.col("minVotes"))
    return c.select("case_ord", *[v[n].alias(n) for n in
                                  ["votes_in_favor", "votes_against", "votes_absent",
                                   "pct_in_favor", "pct_against", "pct_absent"]])


@query("name_code_map", sql=with_("member_book") + """
SELECT s.s_suppkey, coalesce(b.name, s.s_name) AS name
FROM supplier s LEFT JOIN member_book b ON b.code = s.s_name""")
def q_name_code_map(spark, d):
    s = binding(spark, d, "supplier").select("s_suppkey", "s_name")
    return decode.name_code_map(s, "s_name", binding(spark, d, "member_book")).select("s_suppkey", "name")


def abbr_book(spark):
    return spark.createDataFrame(sorted(cb.STATE_ABBREVIATIONS.items()), "abbr string, name string")


@query("state_name_map", sql=with_("justices", "book_abbr") + """
SELECT member_ord, CASE WHEN coalesce(state, '') = '' THEN ''
                        ELSE coalesce((SELECT name FROM book_abbr b WHERE b.abbr = j.state), state) END AS state_full
FROM justices j""")
def q_state_name_map(spark, d):
    j = binding(spark, d, "justices")
    return decode.state_name_map(j, "state", abbr_book(spark)).select("member_ord", "state_full")


@query("url_correction", sql=with_("named_members", "book_names") + f"""
SELECT member_ord, name,
  coalesce((SELECT '{cb.ARTICLE_URL_PREFIX}' || title FROM book_names b WHERE b.cname = m.name),
           '{cb.ARTICLE_URL_PREFIX}' || replace(name, ' ', '_')) AS url
FROM named_members m""")
def q_url_correction(spark, d):
    m = binding(spark, d, "named_members")
    m = m.withColumn("orig", F.concat(F.lit(cb.ARTICLE_URL_PREFIX), F.replace("name", F.lit(" "), F.lit("_"))))
    book = spark.createDataFrame(sorted(cb.NAME_CORRECTIONS.items()), "name string, title string")
    return decode.url_correction(m, "name", "orig", book, cb.ARTICLE_URL_PREFIX).select("member_ord", "name", "url")


shared("share_text", """
SELECT case_ord, CASE case_ord % 4 WHEN 0 THEN '' WHEN 1 THEN '-1'
                 ELSE CAST(o_totalprice / 1000000 AS STRING) END AS s
FROM {cases_base}""")


@query("parse_share_sentinel", sql=with_("share_text") + """
SELECT case_ord, CASE WHEN s IS NULL OR s = '' OR s = '-1' THEN -1.0 ELSE TRY_CAST(s AS DOUBLE) END AS share
FROM share_text""")
def q_parse_share_sentinel(spark, d):
    s = binding(spark, d, "share_text")
    return s.select("case_ord", decode.parse_share_sentinel(F.col("s")).alias("share"))


# ---------------------------------------------------------------- bios

def header_frame(spark, d):
    j = binding(spark, d, "justices")
    j = decode.state_name_map(j, "state", abbr_book(spark))
    return j.withColumn("header", text.metadata_header(
        F.col("name"), F.col("state_full"), F.col("birth_death"), F.col("position"),
        F.col("appointment_date"), F.col("appointment_method"), F.col("nominated_by")))


HEADER_SQL = f"""
SELECT j.*, 'Justice: ' || name
  || CASE WHEN state_full <> '' THEN chr(10) || 'State: ' || state_full ELSE '' END
  || CASE WHEN ({BIRTH_SQL}) IS NOT NULL THEN chr(10) || 'Birth Year: ' || ({BIRTH_SQL}) ELSE '' END
  || CASE WHEN coalesce(position, '') <> '' THEN chr(10) || 'Position: ' || position ELSE '' END
  || CASE WHEN coalesce({date_notes_sql('appointment_date')}, '') <> ''
          THEN chr(10) || 'Appointment Date: ' || {date_notes_sql('appointment_date')} ELSE '' END
  || CASE WHEN coalesce({strip_sql('appointment_method')}, '') <> ''
          THEN chr(10) || 'Appointment Method: ' || appointment_method ELSE '' END
  || CASE WHEN coalesce({strip_sql('nominated_by')}, '') <> ''
          THEN chr(10) || 'Nominated By: ' || nominated_by ELSE '' END
  || chr(10) || chr(10) AS header
FROM (SELECT j.*, CASE WHEN coalesce(state, '') = '' THEN ''
             ELSE coalesce((SELECT name FROM {{book_abbr}} b WHERE b.abbr = j.state), state) END AS state_full
      FROM {{justices}} j) j"""
define("justice_headers", None, HEADER_SQL)


@query("metadata_header", sql=with_("justice_headers") + "SELECT member_ord, header FROM justice_headers")
def q_metadata_header(spark, d):
    return header_frame(spark, d).select("member_ord", "header")


# The bio file key is the slug of the raw name; the header is found by the
# name derived back from the file name (``_`` → space), so names with a full
# stop get no header.
def _bio_sql():
    from docket.plans.q_strings import HEAD_RE, SECTION_RE, pos_sql
    hp = pos_sql("b.text", HEAD_RE)
    inner = f"""
SELECT b.member_ord, h.header, b.text, {hp} > 0 AS intro_removed,
  CASE WHEN {hp} > 0 THEN {strip_sql(f'substr(b.text, {hp})')} ELSE b.text END AS after
FROM {{bios_raw}} b LEFT JOIN {{justice_headers}} h ON h.name = b.raw_name"""
    sp = pos_sql("after", SECTION_RE)
    mid = f"""
SELECT *, {sp} > 0 AS section_cut,
  {trailing_sql(f"CASE WHEN {sp} > 0 THEN {strip_sql(f'substr(after, 1, {sp} - 1)')} ELSE after END")} AS cleaned
FROM bio_step1"""
    final = f"""
SELECT member_ord, CASE WHEN header IS NOT NULL THEN header || cleaned ELSE cleaned END AS processed,
  intro_removed, section_cut, intro_removed OR section_cut AS truncated,
  {wc_sql('text')} AS original_words, CAST(length(text) AS INT) AS original_chars
FROM bio_step2"""
    define("bio_step1", None, inner)
    define("bio_step2", None, mid)
    define("bio_clean", None, final)


_bio_sql()


@query("clean_biography", sql=with_("bio_clean") + f"""
SELECT member_ord, processed, intro_removed, section_cut, truncated, original_words, original_chars,
  {wc_sql('processed')} AS processed_words, CAST(length(processed) AS INT) AS processed_chars,
  original_words - {wc_sql('processed')} AS reduction_words,
  original_chars - CAST(length(processed) AS INT) AS reduction_chars
FROM bio_clean""")
def q_clean_biography(spark, d):
    b = binding(spark, d, "bios_raw")
    h = header_frame(spark, d).select(F.col("name").alias("__hn"), "header")
    j = b.join(h, b.raw_name == h.__hn, "left")
    out = text.clean_biography(j, "text", "header")
    return out.select("member_ord", "processed", "intro_removed", "section_cut", "truncated",
                      "original_words", "original_chars", "processed_words", "processed_chars",
                      "reduction_words", "reduction_chars")

