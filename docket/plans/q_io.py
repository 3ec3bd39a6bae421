"""Queries for sources, sinks (round trips through the shared scratch
folder), HTML jobs, table-cell records and tolerant record layouts
(SURVEY §2.1, §2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docket.functions import strings as S
from docket.operators import html, records_layout
from docket.plans.bindings import binding, define, shared, with_
from docket.plans.q_cases import case_table
from docket.plans.q_joins import REC_OUT_SQL, records_frame, records_out
from docket.plans.q_splits import holdout
from docket.plans.q_tokens import TOK_OUT_SQL, doc_tokens, tok_out
from docket.plans.registry import query
from docket.session import scratch_path
from docket.sources import files
from docket.sources.tables import table

VOTE_COLS = [f.name for f in files.VOTES_SCHEMA.fields]


@query("scan_csv_votes", sql=with_("votes") + f"SELECT {', '.join(VOTE_COLS)} FROM votes")
def q_scan_csv_votes(spark, d):
    path = scratch_path(spark, "votes_csv")
    binding(spark, d, "votes").select(*VOTE_COLS).write.mode("overwrite").option("header", True).csv(path)
    return files.scan_csv_votes(spark, path)


@query("require_columns", sql=with_("votes") + f"SELECT {', '.join(VOTE_COLS)} FROM votes")
def q_require_columns(spark, d):
    return files.require_columns(binding(spark, d, "votes"), VOTE_COLS)


JUSTICE_FIELDS = ["member_ord", "code", "birth_death", "state", "position", "appointment_date",
                  "appointment_method", "nominated_by", "tenure_text"]


@query("scan_json_map", sql=with_("justices") + f"SELECT name AS key, {', '.join(JUSTICE_FIELDS)} FROM justices")
def q_scan_json_map(spark, d):
    path = scratch_path(spark, "justices_json")
    j = binding(spark, d, "justices").select("name", *JUSTICE_FIELDS)
    schema = T.StructType([T.StructField(c, T.LongType() if c == "member_ord" else T.StringType())
                           for c in JUSTICE_FIELDS])
    # indented whole-file objects, as the original stores its maps
    files.write_json_objects(j.select("name", F.to_json(F.struct(*JUSTICE_FIELDS)).alias("v")), path, "name", "v", 5000)
    return files.scan_json_map(spark, path, schema, "key", whole_file=True)


@query("scan_text_dir", sql=with_("bios_raw") + """
SELECT CAST(member_ord AS VARCHAR) AS key,
       regexp_replace(text, '^[\\t\\n\\x0B\\f\\r ]+|[\\t\\n\\x0B\\f\\r ]+$', '', 'g') AS text
FROM bios_raw WHERE regexp_replace(text, '^[\\t\\n\\x0B\\f\\r ]+|[\\t\\n\\x0B\\f\\r ]+$', '', 'g') <> ''""")
def q_scan_text_dir(spark, d):
    path = scratch_path(spark, "bios_txt")
    files.write_keyed_text(binding(spark, d, "bios_raw").select(F.col("member_ord").alias("key"), "text"), path, "key")
    return files.scan_keyed_text(spark, path, "key")


shared("listed_keys", """
SELECT key FROM {bio_files} WHERE member_ord % 3 = 0
UNION ALL SELECT 'Ghost_' || CAST(member_ord AS STRING) AS key FROM {bio_files} WHERE member_ord % 10 = 1""")


@query("scan_listed_files", sql=with_("bio_files", "listed_keys") + """
SELECT key, 'found' AS status FROM bio_files WHERE key IN (SELECT key FROM listed_keys)
UNION ALL SELECT DISTINCT key, 'missing' FROM listed_keys WHERE key NOT IN (SELECT key FROM bio_files)""")
def q_scan_listed_files(spark, d):
    found, missing = files.scan_listed_files(binding(spark, d, "bio_files").select("key"),
                                             binding(spark, d, "listed_keys"))
    return found.withColumn("status", F.lit("found")).unionByName(missing.withColumn("status", F.lit("missing")))


@query("sink_training_records", sql=with_("records") + f"SELECT {REC_OUT_SQL} FROM records")
def q_sink_training_records(spark, d):
    path = scratch_path(spark, "records")
    files.write_table(records_frame(spark, d), path)
    return records_out(spark.read.parquet(path))


@query("sink_keyed_text", sql="SELECT doc_id AS key, length(text) AS n_chars, md5(text) AS h FROM documents")
def q_sink_keyed_text(spark, d):
    path = scratch_path(spark, "keyed_text")
    files.write_table(table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text"), path)
    t = spark.read.parquet(path)
    return t.select("key", F.length("text").alias("n_chars"), F.md5("text").alias("h"))


@query("token_store_roundtrip", sql=with_("vocab", "doc_tokens") + f"""
SELECT {TOK_OUT_SQL}, (SELECT count(*) FROM doc_tokens) AS num_tokenized FROM doc_tokens""")
def q_token_store_roundtrip(spark, d):
    path = scratch_path(spark, "tokens")
    files.save_token_store(doc_tokens(spark, d), {"model_name": "corpus-vocab", "max_sequence_length": 512,
                                                  "tokenization_method": "word"}, path)
    tok, meta = files.load_token_store(spark, path)
    return tok_out(tok).withColumn("num_tokenized", meta.select("num_tokenized").scalar())


@query("holdout_store", sql=with_("holdout") + """
SELECT case_id, CAST((SELECT count(*) FROM holdout) AS BIGINT) AS total_cases, 'records' AS source_dataset
FROM holdout""")
def q_holdout_store(spark, d):
    path = scratch_path(spark, "holdout")
    h = files.holdout_store(spark, path, lambda: holdout(spark, d).select("case_id"), "records")
    return h.select("case_id", F.col("total_cases").cast("long").alias("total_cases"), "source_dataset")


CASE_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ["caseIssuesId", "usCite", "chief", "caseName"]]
    + [T.StructField(c, T.IntegerType()) for c in
       ["petitioner", "petitionerState", "respondentState", "caseOrigin", "caseOriginState", "issueArea", "lawType",
        "caseDisposition", "majVotes", "minVotes", "total_justices_voting", "votes_in_favor", "votes_against",
        "votes_absent"]]
    + [T.StructField(c, T.DoubleType()) for c in ["pct_in_favor", "pct_against", "pct_absent"]]
    + [T.StructField("justice_votes", T.StringType())])


@query("sink_case_csv", sql=with_("cases") + f"SELECT {', '.join(f.name for f in CASE_SCHEMA.fields)} FROM cases")
def q_sink_case_csv(spark, d):
    path = scratch_path(spark, "cases_csv")
    files.sink_case_csv(case_table(spark, d).select(*[f.name for f in CASE_SCHEMA.fields]), path)
    return files.read_case_csv(spark, path, CASE_SCHEMA)


TRIAL_ROWS_SQL = """
SELECT user_id AS trial_number, arg_max(event_type, (ts, event_id)) AS trial_status,
  strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS "end",
  CAST(date_diff('second', min(ts), max(ts)) AS DOUBLE) AS duration_seconds, round(avg(value), 6) AS combined_metric,
  max(value) AS val_loss, round(min(value) / 500.0, 6) AS val_f1_macro, 'events' AS experiment_name
FROM events GROUP BY user_id"""


@query("sink_trial_log", sql=TRIAL_ROWS_SQL)
def q_sink_trial_log(spark, d):
    e = table(spark, d, "events")
    rows = e.groupBy(F.col("user_id").alias("trial_number")).agg(
        F.max_by("event_type", F.struct("ts", "event_id")).alias("trial_status"),
        F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("start"),
        F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("end"),
        (F.unix_timestamp(F.max("ts").cast("timestamp")) - F.unix_timestamp(F.min("ts").cast("timestamp")))
        .cast("double").alias("duration_seconds"),
        F.round(F.avg("value"), 6).alias("combined_metric"), F.max("value").alias("val_loss"),
        F.round(F.min("value") / 500.0, 6).alias("val_f1_macro"), F.lit("events").alias("experiment_name"))
    path = scratch_path(spark, "trial_log")
    files.sink_trial_log(rows.filter(F.col("trial_number") % 2 == 0), path)   # first run writes the layout
    files.sink_trial_log(rows.filter(F.col("trial_number") % 2 == 1), path)   # later runs append
    return spark.read.parquet(path)


@query("html_to_sections")
def q_html_to_sections(spark, d):
    return html.html_to_sections(table(spark, d, "pages"))


@query("html_main_content")
def q_html_main_content(spark, d):
    return html.html_main_content(table(spark, d, "pages"))


# ---------------------------------------------------------------- table cells

def cells_frame(spark, d):
    j = binding(spark, d, "justices")
    href = F.when(j.member_ord % 17 == 0, F.lit("")).otherwise(
        F.concat(F.lit("/wiki/"), F.replace(F.col("name"), F.lit(" "), F.lit("_"))))
    name_cell = F.concat_ws("\t", F.col("name"), href, F.col("birth_death"))
    appt = F.concat(F.col("appointment_date"),
                    F.when(j.member_ord % 6 == 0, F.lit('\n ("Recess") ')).otherwise(F.lit("")))
    full = F.array(F.lit(""), F.col("member_ord").cast("string"), name_cell, F.col("state"), F.col("position"),
                   F.lit(" Member X "), appt, F.col("tenure_text"), F.lit("5 years"), F.col("nominated_by"))
    cells = F.when(j.member_ord % 13 == 0, F.slice(full, 1, 6)).otherwise(full)
    return j.select("member_ord", cells.alias("cells"))


define("cells", None, """
SELECT member_ord, CASE WHEN member_ord % 13 = 0 THEN c[1:6] ELSE c END AS cells FROM (
  SELECT member_ord, ['', CAST(member_ord AS VARCHAR),
     name || chr(9) || CASE WHEN member_ord % 17 = 0 THEN '' ELSE '/wiki/' || replace(name, ' ', '_') END || chr(9)
       || birth_death,
     state, position, ' Member X ',
     appointment_date || CASE WHEN member_ord % 6 = 0 THEN chr(10) || ' ("Recess") ' ELSE '' END,
     tenure_text, '5 years', nominated_by] AS c FROM {justices}) t""")

ST = "'^[\\t\\n\\x0B\\f\\r ]+|[\\t\\n\\x0B\\f\\r ]+$'"


def st(x):
    return f"regexp_replace({x}, {ST}, '', 'g')"


@query("cells_to_record", sql=with_("justices", "cells") + f"""
SELECT {st("split_part(cells[3], chr(9), 1)")} AS name,
  'https://en.wikipedia.org' || split_part(cells[3], chr(9), 2) AS url,
  {st("split_part(cells[3], chr(9), 3)")} AS birth_death,
  {st("cells[4]")} AS state,
  CASE WHEN strpos(cells[5], 'Chief') > 0 THEN 'Chief Justice' ELSE 'Associate Justice' END AS position,
  {st("cells[6]")} AS replaced,
  {st("split_part(cells[7], chr(10), 1)")} AS appointment_date,
  CASE WHEN len(string_split(cells[7], chr(10))) > 1
       THEN trim({st("string_split(cells[7], chr(10))[2]")}, '"()') ELSE '' END AS appointment_method,
  CASE WHEN len(cells) > 7 AND strpos(cells[8], '–') > 0 THEN {st("split_part(cells[8], '–', 1)")} ELSE '' END
    AS tenure_start,
  CASE WHEN len(cells) > 8 THEN {st("cells[9]")} ELSE '' END AS tenure_length,
  CASE WHEN len(cells) > 9 THEN {st("cells[10]")} ELSE '' END AS nominated_by
FROM cells WHERE len(cells) >= 7 AND split_part(cells[3], chr(9), 2) <> ''""")
def q_cells_to_record(spark, d):
    r = records_layout.cells_to_record(cells_frame(spark, d))
    return r.select("name", "url", "birth_death", "state", "position", "replaced", "appointment_date",
                    "appointment_method", "tenure_start", "tenure_length", "nominated_by")


shared("record_json", """
SELECT case_ord, CASE case_ord % 4
  WHEN 0 THEN '[["' || case_id || '_a.txt", "' || case_id || '_b.txt"], "' || coalesce(usCite, '') || '", ['
              || CAST(case_ord % 9 AS STRING) || ', 1, 2]]'
  WHEN 1 THEN '[["' || case_id || '.txt"], "d.txt", [1, 0, 0], ' || chr(123) || '"bio": "bios.parquet", "description": null'
              || chr(125) || ']'
  WHEN 2 THEN '[["' || case_id || '.txt"], "d.txt"]'
  ELSE '[[], null, [-1, -1, -1]]' END AS rec
FROM {cases_base}""")


@query("record_layout_tolerant", sql=with_("record_json") + """
SELECT case_ord, CAST(json_array_length(rec) AS INT) AS n_elems, json_array_length(rec) IN (3, 4) AS valid,
  CASE WHEN json_array_length(rec) IN (3, 4) THEN CAST(json_array_length(rec -> '$[0]') AS INT) END AS n_bios,
  CASE WHEN json_array_length(rec) IN (3, 4) THEN rec ->> '$[1]' END AS description,
  CASE WHEN json_array_length(rec) IN (3, 4) THEN
    (SELECT sum(CAST(x AS DOUBLE)) FROM (SELECT unnest(from_json(rec -> '$[2]', '["DOUBLE"]')) AS x)) END AS t_sum,
  CASE WHEN json_array_length(rec) = 4 THEN rec ->> '$[3].bio' END AS loc_bio,
  CASE WHEN json_array_length(rec) IN (3, 4) THEN ''
       ELSE 'unexpected record layout with ' || CAST(json_array_length(rec) AS VARCHAR) || ' elements' END AS message
FROM record_json""")
def q_record_layout_tolerant(spark, d):
    # written and read as the original stores the case dataset: indented objects keyed by case id, list values
    path = scratch_path(spark, "case_dataset")
    rows = binding(spark, d, "record_json").select(F.col("case_ord"), "rec")
    files.write_json_objects(rows, path, "case_ord", "rec", 5000)
    scanned = files.scan_json_map(spark, path, None, "case_ord", whole_file=True)
    r = records_layout.parse_record_layout(scanned.select(F.col("case_ord").cast("long").alias("case_ord"), "value"), "value")
    return r.select("case_ord", "n_elems", "valid", F.size("bios").alias("n_bios"), "description",
                    F.aggregate("target", F.lit(0.0), lambda a, x: a + x).alias("t_sum"),
                    F.col("locations.bio").alias("loc_bio"), "message")
