"""Queries for description parsing, record assembly, key joins, dedup and
filters (SURVEY §2.2-2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docket.functions import strings as S
from docket.operators import decode, records, text
from docket.plans.bindings import binding, define, shared, with_
from docket.plans.q_cases import case_table
from docket.plans.q_records import DECODES, code_sql, decode_all
from docket.plans.q_strings import SP, WORD, WS, strip_sql, wc_sql
from docket.plans.registry import query

# ---------------------------------------------------------------- description files

define("desc_parsed_all", None, f"""
SELECT file_ord, file_key,
  CASE WHEN regexp_matches(text, '(?m)^====') THEN regexp_extract(text, '\\A((?s:.*?))(?m:^)====', 1) END AS head,
  text
FROM {{desc_files}}""")

define("desc_parsed_rows", None, f"""
SELECT file_ord, file_key,
  CASE WHEN regexp_matches(head, '(?m)^Case ID:') THEN
    {strip_sql("replace(regexp_extract(head, '(?s)\\A.*(?m:^)Case ID:([^\\n]*)', 1), 'Case ID:', '')")} END AS case_id,
  CASE WHEN regexp_matches(head, '(?m)^Citation:') THEN
    {strip_sql("replace(regexp_extract(head, '(?s)\\A.*(?m:^)Citation:([^\\n]*)', 1), 'Citation:', '')")} END AS citation,
  {strip_sql("CASE WHEN strpos(substr(text, length(head) + 1), chr(10)) > 0 THEN substr(substr(text, length(head) + 1), strpos(substr(text, length(head) + 1), chr(10)) + 1) ELSE '' END")} AS body
FROM {{desc_parsed_all}} WHERE head IS NOT NULL""")

define("desc_parsed", None, """
SELECT case_id, arg_max(file_ord, file_ord) AS file_ord, arg_max(file_key, file_ord) AS file_key,
       arg_max(citation, file_ord) AS citation, arg_max(body, file_ord) AS body
FROM {desc_parsed_rows}
WHERE coalesce(case_id, '') <> '' AND coalesce(body, '') <> ''
GROUP BY case_id""")


def parsed_descriptions(spark, d):
    return text.parse_doc_header(binding(spark, d, "desc_files"))


@query("parse_doc_header", sql=with_("desc_parsed") + "SELECT case_id, file_ord, file_key, citation, body FROM desc_parsed")
def q_parse_doc_header(spark, d):
    return parsed_descriptions(spark, d).select("case_id", "file_ord", "file_key", "citation", "body")


# ---------------------------------------------------------------- case ⟕ description (step 8)

def base_name_sql(cite: str, case_id: str) -> str:
    san = (f"regexp_replace(regexp_replace({cite}, '[^{WORD}{SP}.\\-]', '', 'g'), '{WS}+', '_', 'g')")
    return f"CASE WHEN {cite} IS NOT NULL THEN {san} ELSE 'case_' || {case_id} END"


define("case_desc_join", None, f"""
SELECT c.*, p.body, p.case_id IS NOT NULL AS matched,
  CASE WHEN p.case_id IS NOT NULL THEN {base_name_sql('c.usCite', 'c.caseIssuesId')} || '_v0.txt' END AS out_file
FROM {{cases}} c LEFT JOIN {{desc_parsed}} p ON p.case_id = c.caseIssuesId""")


def case_desc_join(spark, d):
    cases = case_table(spark, d)
    p = parsed_descriptions(spark, d).select(F.col("case_id").alias("__pid"), "body")
    j = cases.join(p, cases.caseIssuesId == p.__pid, "left")
    base = F.when(F.col("usCite").isNotNull(), F.regexp_replace(S.sanitize_citation(F.col("usCite")), r"\.txt$", "")) \
        .otherwise(F.concat(F.lit("case_"), F.col("caseIssuesId")))
    return (j.withColumn("matched", F.col("__pid").isNotNull())
            .withColumn("out_file", F.when(F.col("matched"), F.concat(base, F.lit("_v0.txt"))))
            .drop("__pid"))


@query("join_case_description", sql=with_("cases", "case_desc_join") + """
SELECT caseIssuesId, matched, out_file FROM case_desc_join""")
def q_join_case_description(spark, d):
    return case_desc_join(spark, d).select("caseIssuesId", "matched", "out_file")


SUMMARY_DECODES = [(c, b, ("" if "state" in o else dflt), o) for c, b, dflt, o in DECODES]


def _summary_sql():
    from docket.plans.q_records import decode_sql

    def shown(x):
        return f"(coalesce({x}, '') <> '' AND {x} <> 'Not specified')"

    lab = {o: decode_sql(c, b, dflt) for c, b, dflt, o in SUMMARY_DECODES}
    return f"""
SELECT out_file,
  'Case: ' || coalesce(caseName, 'nan') || ' (' || coalesce(usCite, 'nan') || ')' || chr(10) || chr(10)
  || 'This Supreme Court case was decided under Chief Justice ' || coalesce(chief, 'nan')
  || '. The petitioner was ' || pl
  || CASE WHEN {shown('psl')} THEN ' from ' || psl ELSE '' END
  || CASE WHEN {shown('rsl')} THEN '. The respondent was from ' || rsl ELSE '' END
  || '.' || chr(10) || chr(10) || 'The case originated from ' || ol
  || CASE WHEN {shown('osl')} THEN ' in ' || osl ELSE '' END
  || '. The primary issue area was ' || il || '.' || chr(10) || chr(10) || body AS summary
FROM (SELECT *, {lab['petitioner_label']} AS pl, {lab['petitioner_state_label']} AS psl,
        {lab['respondent_state_label']} AS rsl, {lab['origin_label']} AS ol,
        {lab['origin_state_label']} AS osl, {lab['issue_label']} AS il
      FROM {{case_desc_join}} WHERE matched) t"""


define("case_summaries", None, _summary_sql())


def case_summaries(spark, d):
    j = case_desc_join(spark, d).filter("matched")
    j = decode_all(spark, j, SUMMARY_DECODES)
    return j.select("out_file", "caseIssuesId", text.render_case_summary(
        F.col("caseName"), F.col("usCite"), F.col("chief"), F.col("petitioner_label"),
        F.col("petitioner_state_label"), F.col("respondent_state_label"), F.col("origin_label"),
        F.col("origin_state_label"), F.col("issue_label"), F.col("body")).alias("summary"))


@query("render_case_summary", sql=with_("cases", "case_desc_join", "case_summaries", "book_petitioner", "book_state",
                                        "book_origin", "book_issue") + "SELECT out_file, summary FROM case_summaries")
def q_render_case_summary(spark, d):
    return case_summaries(spark, d).select("out_file", "summary")


def _outcome_sql():
    from docket.plans.q_records import decode_sql
    lab = {o: decode_sql(c, b, dflt) for c, b, dflt, o in DECODES}

    def shown(x):
        return f"({x} <> 'Not specified' AND {x} <> 'Unknown state')"

    def pct(x):
        return f"printf('%.1f', CASE WHEN {x} <> -1 THEN {x} * 100.0 ELSE 0.0 END)"

    disp = "coalesce(CAST(caseDisposition AS VARCHAR), 'nan')"
    fav, ag, ab = "votes_in_favor", "votes_against", "votes_absent"
    margin = (f"CASE WHEN {fav} > {ag} AND {ag} = 0 THEN 'unanimous' "
              f"WHEN {fav} > {ag} THEN {fav} || '-' || {ag} WHEN {ag} > {fav} THEN {ag} || '-' || {fav} "
              f"ELSE {fav} || '-' || {ag} END")
    outcome = (f"CASE WHEN {fav} > {ag} THEN 'ruled in favor of the petitioner' WHEN {ag} > {fav} "
               f"THEN 'ruled against the petitioner' ELSE 'resulted in a tie' END")
    return f"""
SELECT regexp_replace(caseIssuesId, '[^{WORD}\\-.]', '_', 'g') || '.txt' AS file_name,
  'Case: ' || coalesce(caseName, 'nan') || ' (' || coalesce(usCite, 'nan') || ')' || chr(10) || chr(10)
  || 'This Supreme Court case was decided under Chief Justice ' || coalesce(chief, 'nan')
  || '. The petitioner was ' || pl
  || CASE WHEN {shown('psl')} THEN ' from ' || psl ELSE '' END
  || CASE WHEN {shown('rsl')} THEN '. The respondent was from ' || rsl ELSE '' END
  || chr(10) || chr(10) || 'The case originated from ' || ol
  || CASE WHEN {shown('osl')} THEN ' in ' || osl ELSE '' END
  || '. The primary issue area was ' || il || '.'
  || CASE WHEN {fav} = -1 OR {ag} = -1 OR {ab} = -1 THEN
       chr(10) || chr(10) || 'The case outcome could not be clearly determined from the available data (case disposition: '
       || {disp} || '). The court''s decision on this case falls into an unclear category.'
     ELSE
       chr(10) || chr(10) || 'The Supreme Court ' || {outcome} || ' by a ' || {margin}
       || ' margin. The voting breakdown was:' || chr(10) || '- ' || {fav}
       || ' justices voted in favor of the petitioner (' || {pct('pct_in_favor')} || '%)' || chr(10) || '- '
       || {ag} || ' justices voted against the petitioner (' || {pct('pct_against')} || '%)'
       || CASE WHEN {ab} > 0 THEN chr(10) || '- ' || {ab} || ' justices were absent or recused ('
               || {pct('pct_absent')} || '%)' ELSE '' END
       || chr(10) || chr(10) || 'The majority opinion comprised ' || coalesce(CAST(majVotes AS VARCHAR), 'nan')
       || ' justices, while ' || coalesce(CAST(minVotes AS VARCHAR), 'nan')
       || ' justices were in the minority (case disposition code: ' || {disp} || ').'
     END AS description
FROM (SELECT *, {lab['petitioner_label']} AS pl, {lab['petitioner_state_label']} AS psl,
        {lab['respondent_state_label']} AS rsl, {lab['origin_label']} AS ol,
        {lab['origin_state_label']} AS osl, {lab['issue_label']} AS il FROM {{cases}}) t"""


define("case_outcomes", None, _outcome_sql())


@query("render_case_outcome", sql=with_("cases", "case_outcomes", "book_petitioner", "book_state", "book_origin",
                                        "book_issue") + "SELECT file_name, description FROM case_outcomes")
def q_render_case_outcome(spark, d):
    c = decode_all(spark, case_table(spark, d))
    cols = {n: F.col(n) for n in c.columns}
    return c.select(S.sanitize_case_id(F.col("caseIssuesId")).alias("file_name"),
                    text.render_case_outcome(cols).alias("description"))


# ---------------------------------------------------------------- records

define("rec_parts", None, """
SELECT caseIssuesId AS case_id, pos, split_part(regexp_replace(part, '^[\\t\\n\\x0B\\f\\r ]+|[\\t\\n\\x0B\\f\\r ]+$', '', 'g'), ':', 1) AS code,
       part
FROM (SELECT caseIssuesId, unnest(string_split(justice_votes, ';')) AS part,
             generate_subscripts(string_split(justice_votes, ';'), 1) - 1 AS pos FROM {cases}) t
WHERE regexp_replace(part, '^[\\t\\n\\x0B\\f\\r ]+|[\\t\\n\\x0B\\f\\r ]+$', '', 'g') <> ''""")

define("rec_first", None, """
SELECT p.case_id, coalesce(b.name, p.code) AS name, min(p.pos) AS pos
FROM {rec_parts} p LEFT JOIN {member_book} b ON b.code = p.code GROUP BY 1, 2""")

define("rec_bios", None, f"""
SELECT case_id, list(name ORDER BY pos) AS names
FROM {{rec_first}} WHERE name IN (SELECT key FROM {{bio_files}}) GROUP BY case_id""")

define("records", None, f"""
SELECT c.caseIssuesId AS case_id,
  coalesce(list_transform(rb.names, lambda n: '{records.BIO_DIR}' || n || '.txt'), []) AS bios,
  CASE WHEN dk.file_key IS NOT NULL THEN '{records.DESC_DIR}' || dk.file_key || '.txt' END AS description,
  c.pct_in_favor AS t_in_favor, c.pct_against AS t_against, c.pct_absent AS t_absent
FROM {{cases}} c
LEFT JOIN {{desc_keys}} dk ON dk.file_key = CASE WHEN c.usCite IS NULL OR c.usCite IN ('nan', '') THEN NULL
                                             ELSE replace(c.usCite, ' ', '_') END
LEFT JOIN {{rec_bios}} rb ON rb.case_id = c.caseIssuesId""")

REC_OUT_SQL = """case_id, array_to_string(bios, '|') AS bios, CAST(len(bios) AS INT) AS n_bios, description,
  t_in_favor, t_against, t_absent"""


def records_frame(spark, d):
    # a record holds no other column of its case
    return records.assemble_training_records(case_table(spark, d, attrs=["usCite"]), binding(spark, d, "member_book"),
                                             binding(spark, d, "bio_files"), binding(spark, d, "desc_keys"))


def records_out(r):
    return r.select("case_id", F.array_join("bios", "|").alias("bios"), F.size("bios").alias("n_bios"),
                    "description", F.col("target")[0].alias("t_in_favor"), F.col("target")[1].alias("t_against"),
                    F.col("target")[2].alias("t_absent"))


@query("assemble_training_records", sql=with_("records") + f"SELECT {REC_OUT_SQL} FROM records")
def q_assemble_training_records(spark, d):
    return records_out(records_frame(spark, d))


@query("parse_votes", sql=with_("cases") + """
SELECT caseIssuesId, array_to_string(codes, '|') AS codes, CAST(len(codes) AS INT) AS n_codes FROM (
  SELECT caseIssuesId, list_filter(allc, lambda x, i: list_position(allc, x) = i) AS codes FROM (
    SELECT caseIssuesId, list_transform(list_filter(string_split(justice_votes, ';'),
             lambda p: regexp_replace(p, '^[\\t\\n\\x0B\\f\\r ]+|[\\t\\n\\x0B\\f\\r ]+$', '', 'g') <> ''),
             lambda p: split_part(regexp_replace(p, '^[\\t\\n\\x0B\\f\\r ]+|[\\t\\n\\x0B\\f\\r ]+$', '', 'g'), ':', 1)) AS allc
    FROM cases) t) u""")
def q_parse_votes(spark, d):
    c = case_table(spark, d).select("caseIssuesId", S.parse_votes(F.col("justice_votes")).alias("codes"))
    return c.select("caseIssuesId", F.array_join("codes", "|").alias("codes"), F.size("codes").alias("n_codes"))


@query("join_votes_to_bios", sql=with_("cases", "rec_bios") + """
SELECT case_id, array_to_string(names, '|') AS names, CAST(len(names) AS INT) AS n_bios FROM rec_bios""")
def q_join_votes_to_bios(spark, d):
    m = records.vote_members(case_table(spark, d), binding(spark, d, "member_book"), binding(spark, d, "bio_files"))
    names = F.transform("bios", lambda p: F.regexp_replace(S.basename(p), r"\.txt$", ""))
    return m.select("case_id", F.array_join(names, "|").alias("names"), F.size("bios").alias("n_bios"))


@query("join_by_citation", sql=with_("cases", "desc_keys") + f"""
SELECT c.caseIssuesId, CASE WHEN dk.file_key IS NOT NULL THEN '{records.DESC_DIR}' || dk.file_key || '.txt' END
  AS description
FROM cases c LEFT JOIN desc_keys dk ON dk.file_key = CASE WHEN c.usCite IS NULL OR c.usCite IN ('nan', '') THEN NULL
                                                     ELSE replace(c.usCite, ' ', '_') END""")
def q_join_by_citation(spark, d):
    j = records.join_by_citation(case_table(spark, d), binding(spark, d, "desc_keys"))
    return j.select("caseIssuesId", "description")


# Case-metadata store (step-7 outputs): every 8th case's file is missing.
shared("case_meta_keys", """
SELECT case_id FROM {cases_base} WHERE case_ord % 8 <> 3""")


@query("join_case_metadata_key", sql=with_("cases", "case_meta_keys") + """
SELECT caseIssuesId FROM cases WHERE caseIssuesId IN (SELECT case_id FROM case_meta_keys)""")
def q_join_case_metadata_key(spark, d):
    c = case_table(spark, d)
    k = binding(spark, d, "case_meta_keys")
    return c.join(k, c.caseIssuesId == k.case_id, "left_semi").select("caseIssuesId")


@query("add_locations", sql=with_("records") + """
SELECT case_id, 'data/processed/encoded_bios.parquet' AS loc_bio, CAST(NULL AS VARCHAR) AS loc_description
FROM records""")
def q_add_locations(spark, d):
    r = records.add_locations(records_frame(spark, d), "data/processed/encoded_bios.parquet", None)
    return r.select("case_id", F.col("locations.bio").alias("loc_bio"),
                    F.col("locations.description").alias("loc_description"))


# ---------------------------------------------------------------- dedup

# Case CSV rows with repeats: every 5th case re-appears under the next
# case's id (a later row; the first must win).
shared("case_rows", """
SELECT case_id, case_ord, 0 AS src, usCite FROM {cases_base}
UNION ALL
SELECT n.case_id, n.case_ord, 1 AS src, c.usCite
FROM {cases_base} c JOIN {cases_base} n ON n.case_ord = c.case_ord + 1 WHERE c.case_ord % 5 = 0""")


@query("dedup_first_by_case", sql=with_("case_rows") + """
SELECT case_id, arg_min(usCite, (src, case_ord)) AS usCite, arg_min(src, (src, case_ord)) AS src
FROM case_rows GROUP BY case_id""")
def q_dedup_first_by_case(spark, d):
    r = binding(spark, d, "case_rows")
    return text.dedup_first(r.select("case_id", "src", "case_ord", "usCite"), ["case_id"], ["src", "case_ord"]) \
        .select("case_id", "usCite", "src")


shared("dedup_cites", """
SELECT case_ord, case_id,
  CASE WHEN case_ord % 50 = 0 THEN NULL
       ELSE CAST(300 + o_custkey % 300 AS STRING) || ' U.S. ' || CAST(case_ord % 97 AS STRING) END AS usCite
FROM {cases_base}""")


@query("dedup_by_citation", sql=with_("dedup_cites") + """
SELECT usCite, arg_min(case_id, case_ord) AS case_id, min(case_ord) AS case_ord FROM dedup_cites GROUP BY usCite""")
def q_dedup_by_citation(spark, d):
    c = binding(spark, d, "dedup_cites")
    return text.dedup_first(c, ["usCite"], ["case_ord"]).select("usCite", "case_id", "case_ord")


# ---------------------------------------------------------------- filters

@query("filter_has_description", sql=with_("records") + f"""
SELECT case_id FROM records
WHERE description IS NOT NULL AND {strip_sql('description')} <> ''
  AND replace(replace(description, '{records.DESC_DIR}', ''), '.txt', '') IN (SELECT file_key FROM desc_keys)""")
def q_filter_has_description(spark, d):
    from docket.operators.filters import filter_has_description
    r = records_frame(spark, d)
    keys = binding(spark, d, "desc_keys")
    return filter_has_description(r, keys).select("case_id")


@query("filter_year_range", sql=with_("cases_base") + """
SELECT case_ord, year FROM cases_base WHERE year BETWEEN 1996 AND 1999""")
def q_filter_year_range(spark, d):
    from docket.operators.filters import filter_year_range
    return filter_year_range(binding(spark, d, "cases_base"), "year", 1996, 1999).select("case_ord", "year")


@query("filter_valid_cases", sql=with_("cases") + """
SELECT caseIssuesId, pct_in_favor <> -1 AS valid FROM cases""")
def q_filter_valid_cases(spark, d):
    from docket.operators.filters import split_valid
    return split_valid(case_table(spark, d)).select("caseIssuesId", "valid")
