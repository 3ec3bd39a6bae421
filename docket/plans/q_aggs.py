"""Queries for reports, gates and text filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from docket.functions import strings as S
from docket.operators import filters, leakage, reports
from docket.plans.bindings import binding, define, shared, with_
from docket.plans.q_cases import case_table
from docket.plans.q_joins import records_frame
from docket.plans.q_strings import WS, strip_sql, wc_sql
from docket.plans.registry import query
from docket.sources.tables import table


@query("case_summary_stats", sql=with_("cases") + """
SELECT round(avg(CASE WHEN pct_in_favor <> -1 THEN pct_in_favor END), 6) AS avg_in_favor,
       round(avg(CASE WHEN pct_in_favor <> -1 THEN pct_against END), 6) AS avg_against,
       round(avg(CASE WHEN pct_in_favor <> -1 THEN pct_absent END), 6) AS avg_absent,
       count_if(pct_in_favor <> -1) AS n_valid, count_if(pct_in_favor = -1) AS n_invalid,
       count_if(pct_in_favor <> -1 AND pct_in_favor = 1.0) AS n_unanimous,
       count_if(pct_in_favor <> -1 AND pct_absent = 0.0) AS n_no_absent,
       count(DISTINCT chief) AS n_chiefs,
       min(substr(caseIssuesId, 1, 4)) AS first_year, max(substr(caseIssuesId, 1, 4)) AS last_year
FROM cases""")
def q_case_summary_stats(spark, d):
    return reports.case_summary_stats(case_table(spark, d))


@query("expected_count", sql=with_("dedup_cites") + """
SELECT count(DISTINCT usCite) AS n_unique,
       count(DISTINCT usCite) + max(CASE WHEN usCite IS NULL THEN 1 ELSE 0 END) AS n_distinct_rows
FROM dedup_cites""")
def q_expected_count(spark, d):
    return reports.expected_count(binding(spark, d, "dedup_cites"), "usCite")


@query("completeness_gate", sql=with_("cases", "desc_files") + """
SELECT expected, found, expected - found AS missing,
  round(CASE WHEN expected > 0 THEN found * 100.0 / expected END, 6) AS pct,
  found > 0 AND (expected <= 0 OR expected - found <= 150) AS complete
FROM (SELECT (SELECT count(DISTINCT usCite) FROM cases) AS expected,
             (SELECT count(*) FROM desc_files) AS found) t""")
def q_completeness_gate(spark, d):
    expected = case_table(spark, d).agg(F.countDistinct("usCite")).scalar()
    found = binding(spark, d, "desc_files").agg(F.count(F.lit(1))).scalar()
    one = spark.range(1)
    return one.select(expected.alias("expected"), found.alias("found"), (expected - found).alias("missing"),
                      reports.r6(F.when(expected > 0, found * 100.0 / expected)).alias("pct"),
                      reports.completeness_gate(expected, found).alias("complete"))


@query("coverage_report", sql=with_("records", "case_meta_keys") + """
SELECT artefact, found, total, round(CASE WHEN total > 0 THEN found * 100.0 / total END, 6) AS pct,
       total - found AS missing
FROM (SELECT count(*) AS total, count_if(description IS NOT NULL) AS d, count_if(m.case_id IS NOT NULL) AS m,
             count_if(len(bios) > 0) AS b
      FROM records r LEFT JOIN case_meta_keys m ON m.case_id = r.case_id) t,
     (VALUES ('description'), ('metadata'), ('bios')) v(artefact),
     LATERAL (SELECT CASE artefact WHEN 'description' THEN d WHEN 'metadata' THEN m ELSE b END AS found) f""")
def q_coverage_report(spark, d):
    r = records_frame(spark, d)
    k = binding(spark, d, "case_meta_keys").select(F.col("case_id").alias("__m"))
    j = r.join(k, r.case_id == k.__m, "left")
    return reports.coverage(j, {"description": F.col("description").isNotNull(),
                                "metadata": F.col("__m").isNotNull(),
                                "bios": F.size("bios") > 0})


@query("unique_references", sql=with_("records") + """
SELECT (SELECT count(DISTINCT b) FROM (SELECT unnest(bios) AS b FROM records)) AS n_unique_bios,
       (SELECT count(*) FROM (SELECT unnest(bios) AS b FROM records)) AS total_bio_refs,
       count(DISTINCT description) AS n_unique_descriptions, count(description) AS total_description_refs
FROM records""")
def q_unique_references(spark, d):
    return reports.unique_references(records_frame(spark, d))


@query("year_histogram", sql=with_("records") + """
SELECT CAST(coalesce(TRY_CAST(substr(case_id, 1, 4) AS INTEGER), 0) AS INT) AS year, count(*) AS n
FROM records WHERE description IS NOT NULL GROUP BY 1""")
def q_year_histogram(spark, d):
    r = records_frame(spark, d).filter(F.col("description").isNotNull())
    return reports.year_histogram(r.withColumn("year", S.year_from_id(F.col("case_id"))))


@query("text_reduction_stats", sql=with_("bio_clean") + f"""
SELECT count(*) AS n_docs, sum(original_words) AS words_before, sum({wc_sql('processed')}) AS words_after,
  sum(original_chars) AS chars_before, sum(length(processed)) AS chars_after,
  count_if(truncated) AS n_truncated, count_if(intro_removed) AS n_intro_removed,
  count_if(section_cut) AS n_section_cut,
  round(CASE WHEN sum(original_words) > 0
        THEN (sum(original_words) - sum({wc_sql('processed')})) * 100.0 / sum(original_words) END, 6)
        AS pct_word_reduction
FROM bio_clean""")
def q_text_reduction_stats(spark, d):
    from docket.plans.q_records import q_clean_biography
    return reports.text_reduction_stats(q_clean_biography(spark, d))


# ---------------------------------------------------------------- fetch gates

# Raw descriptions: documents with an outcome sentence appended to every 4th.
shared("raw_descriptions", """
SELECT doc_id, CASE WHEN doc_id % 4 = 0
  THEN text || ' The Court held that the statute applies. The vote was 5-4 decision in the end.'
  ELSE text END AS text
FROM {documents}""")


def leak_sql(x: str) -> str:
    pat = leakage.outcome_pattern()
    inner = (f"array_to_string(list_filter(regexp_extract_all({x}, '{leakage.SENTENCE}', 0), "
             f"lambda s: NOT regexp_matches(s, '{pat}')), '')")
    return strip_sql(inner)


define("leak_cut", None, f"""
SELECT doc_id, CASE WHEN length(text) + {1000 + len(S.PROMPT_SUFFIX) + 1} > 30000
  THEN substr(text, 1, {30000 - 1000 - 200}) || '{S.TRUNCATION_MARKER}' ELSE text END AS cut FROM {{raw_descriptions}}""")
define("leak_train", None, f"""
SELECT list_distinct(regexp_extract_all(lower(s), '{leakage.WORD}')) AS words, regexp_matches(s, '{leakage.outcome_pattern()}') AS weak
FROM (SELECT unnest(regexp_extract_all(text, '{leakage.SENTENCE}', 0)) AS s FROM {{raw_descriptions}}) t""")
define("leak_totals", None, "SELECT count_if(weak) AS tp, count_if(NOT weak) AS tn FROM leak_train")
define("leak_weights", None, f"""
SELECT word, weight FROM (
  SELECT word, round(ln((p + 0.5::DOUBLE) / (tp + 1.0::DOUBLE)) - ln((n + 0.5::DOUBLE) / (tn + 1.0::DOUBLE)), 6) AS weight FROM (
    SELECT word, count_if(weak) AS p, count_if(NOT weak) AS n FROM (SELECT weak, unnest(words) AS word FROM leak_train) w
    GROUP BY word HAVING count(*) >= {leakage.LEAST_SENTENCES}) c, leak_totals) x WHERE weight >= {leakage.LEAST_WEIGHT}""")
define("leak_sentences", None, f"""
SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS pos
FROM (SELECT doc_id, regexp_extract_all(cut, '{leakage.SENTENCE}', 0) AS ss FROM leak_cut) t""")
define("leak_scores", None, f"""
SELECT doc_id, pos, sum(weight) AS score
FROM (SELECT doc_id, pos, unnest(list_distinct(regexp_extract_all(lower(s), '{leakage.WORD}'))) AS word FROM leak_sentences) w
JOIN leak_weights USING (word) GROUP BY doc_id, pos""")
define("leak_kept", None, f"""
SELECT doc_id, string_agg(s, '' ORDER BY pos) AS text FROM (
  SELECT t.doc_id, t.pos, t.s, coalesce(score, 0) + (SELECT round(ln((tp + 1.0::DOUBLE) / (tn + 1)), 6) FROM leak_totals) AS odds
  FROM leak_sentences t LEFT JOIN leak_scores c ON c.doc_id = t.doc_id AND c.pos = t.pos) j
WHERE NOT regexp_matches(s, '{leakage.outcome_pattern()}') AND round(odds, 4) <= 0 GROUP BY doc_id""")
LEAK = ("leak_cut", "leak_train", "leak_totals", "leak_weights", "leak_sentences", "leak_scores", "leak_kept")


@query("leakage_sentence_filter", sql=with_("raw_descriptions", *LEAK) + f"""
SELECT c.doc_id, CASE WHEN cut IS NOT NULL THEN {strip_sql("coalesce(k.text, '')")} END AS filtered
FROM leak_cut c LEFT JOIN leak_kept k ON k.doc_id = c.doc_id""")
def q_leakage_sentence_filter(spark, d):
    """The 30 000-character budget first, as the original cuts before its call, then the filter, whose words are
    learnt from all descriptions."""
    r = binding(spark, d, "raw_descriptions")
    weights, prior = leakage.outcome_words(r, "text")
    cut = r.select("doc_id", S.truncate_to_budget(F.col("text"), 1000).alias("cut"))
    return leakage.learnt_filter(cut, "doc_id", "cut", weights, prior)


define_status = f"""
SELECT doc_id,
  CASE WHEN doc_id % 3 <> 0 THEN 'skipped'
       WHEN text IS NULL OR text = '' OR length(text) < 500 THEN 'no_content'
       WHEN f IS NULL OR f = '' OR length(f) < 50 THEN 'api_failed'
       ELSE 'success' END AS status
FROM (SELECT doc_id, text, {leak_sql('text')} AS f FROM raw_descriptions) t"""


def fetch_status(spark, d):
    r = binding(spark, d, "raw_descriptions")
    f = leakage.leakage_sentence_filter(F.col("text"))
    st = F.when(F.col("doc_id") % 3 != 0, F.lit("skipped")).otherwise(filters.length_gate(F.col("text"), f))
    return r.select("doc_id", st.alias("status"))


@query("filter_min_length", sql=with_("raw_descriptions") + define_status)
def q_filter_min_length(spark, d):
    return fetch_status(spark, d)


@query("fetch_status_report", sql=with_("raw_descriptions") + f"""
SELECT status, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS rate
FROM ({define_status}) s GROUP BY status""")
def q_fetch_status_report(spark, d):
    return reports.status_report(fetch_status(spark, d))


@query("filter_max_words", sql=f"""
SELECT doc_id, {wc_sql('text')} AS words, {wc_sql('text')} > 10000 AS skipped FROM documents""")
def q_filter_max_words(spark, d):
    return filters.max_words_gate(table(spark, d, "documents")).select("doc_id", "words", "skipped")


@query("ablate_lines", sql=with_("justice_headers", "bio_clean") + """
SELECT member_ord, array_to_string(list_filter(string_split(processed, chr(10)),
  lambda l: regexp_replace(l, '^[\\t\\n\\x0B\\f\\r ]+|[\\t\\n\\x0B\\f\\r ]+$', '', 'g') <> '' AND NOT ("""
       + " OR ".join(f"starts_with(l, '{t}:')" for t in filters.ABLATE_TERMS) + """)), chr(10)) AS ablated
FROM bio_clean""")
def q_ablate_lines(spark, d):
    from docket.plans.q_records import q_clean_biography
    b = q_clean_biography(spark, d)
    return b.select("member_ord", filters.ablate_lines(F.col("processed")).alias("ablated"))
