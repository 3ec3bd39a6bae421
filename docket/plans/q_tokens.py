"""Queries for vocabulary, encoding, padding, court features, token-store
joins and pretraining pairs (SURVEY §2.3, §2.9-2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docket.functions import strings as S
from docket.operators import tokens as T
from docket.plans.bindings import binding, define, shared, with_
from docket.plans.q_joins import records_frame
from docket.plans.registry import query
from docket.sources import fixtures as fx
from docket.sources.files import stored
from docket.sources.tables import table

def tok_sql(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+')"

define("vocab", None, """
SELECT token, freq, CAST(row_number() OVER (ORDER BY freq DESC, token) - 1 + 4 AS INT) AS id FROM (
  SELECT token, count(*) AS freq FROM (SELECT unnest(""" + tok_sql("text") + """) AS token FROM documents) t
  GROUP BY token) v""")


def vocab(spark, d):
    return T.build_vocab(table(spark, d, "documents"), "text")


@query("build_vocab", sql=with_("vocab") + "SELECT token, freq, id FROM vocab")
def q_build_vocab(spark, d):
    return vocab(spark, d)


def encode_sql(src: str, key: str, text: str) -> str:
    """DuckDB: CLS + first 510 token ids + SEP per document."""
    return f"""
SELECT k.key, k.n_tokens,
  [2] || coalesce((SELECT list(coalesce(v.id, 1) ORDER BY u.pos)
                   FROM (SELECT unnest(k.toks[1:510]) AS tok, generate_subscripts(k.toks[1:510], 1) AS pos) u
                   LEFT JOIN vocab v ON v.token = u.tok), []) || [3] AS input_ids
FROM (SELECT {key} AS key, {tok_sql(text)} AS toks,
             CAST(len({tok_sql(text)}) AS INT) AS n_tokens FROM {src}) k"""


define("doc_tokens", None, encode_sql("documents", "doc_id", "text"))


def doc_tokens(spark, d):
    docs = table(spark, d, "documents")
    return T.tokenize_encode(docs, "doc_id", "text", vocab(spark, d), 512)


TOK_OUT_SQL = """key, n_tokens, CAST(len(input_ids) AS INT) AS n_ids, CAST(list_sum(input_ids) AS BIGINT) AS ids_sum,
  md5(array_to_string(input_ids, ',')) AS ids_md5"""


def tok_out(t):
    return t.select("key", "n_tokens", F.size("input_ids").alias("n_ids"),
                    F.aggregate("input_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("ids_sum"),
                    F.md5(F.array_join("input_ids", ",")).alias("ids_md5"))


@query("tokenize_encode", sql=with_("vocab", "doc_tokens") + f"SELECT {TOK_OUT_SQL} FROM doc_tokens")
def q_tokenize_encode(spark, d):
    return tok_out(doc_tokens(spark, d))


@query("pad_and_mask", sql=with_("vocab", "doc_tokens") + """
SELECT key, batch, CAST(len(padded) AS INT) AS width, CAST(list_sum(mask) AS INT) AS n_real,
       md5(array_to_string(padded, ',')) AS padded_md5 FROM (
  SELECT key, batch, input_ids || list_transform(range(w - len(input_ids)), lambda i: 0) AS padded,
         list_transform(range(len(input_ids)), lambda i: 1) || list_transform(range(w - len(input_ids)), lambda i: 0)
           AS mask
  FROM (SELECT *, CAST(floor(key / 16) AS BIGINT) AS batch,
               max(len(input_ids)) OVER (PARTITION BY CAST(floor(key / 16) AS BIGINT)) AS w FROM doc_tokens) t) p""")
def q_pad_and_mask(spark, d):
    t = doc_tokens(spark, d).withColumn("batch", F.floor(F.col("key") / 16).cast("long"))
    p = T.pad_and_mask(t, "batch")
    return p.select("key", "batch", F.size("padded_ids").alias("width"),
                    F.aggregate("padded_mask", F.lit(0), lambda a, x: a + x).alias("n_real"),
                    F.md5(F.array_join("padded_ids", ",")).alias("padded_md5"))


ORD_SQL = ", ".join("l." + c for c in fx.VOTE_ORD)


@query("court_features", sql=with_("cases_base") + f"""
SELECT c.case_ord AS case_key, CAST(2 + 11 * 2 AS INT) AS n_features, CAST(coalesce(m.n, 0) AS INT) AS justice_count,
  round(c.o_totalprice / 1e5 + (c.year - 1990) / 10.0 + coalesce(m.s, 0), 3) AS feature_sum
FROM cases_base c LEFT JOIN (
  SELECT l_orderkey, count(*) AS n, sum(a + b) AS s FROM (
    SELECT l.l_orderkey, s.s_acctbal / 1e4 AS a, s.s_nationkey / 25.0 AS b,
           row_number() OVER (PARTITION BY l.l_orderkey ORDER BY {ORD_SQL}) AS k
    FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey) x WHERE k <= 11 GROUP BY l_orderkey) m
  ON m.l_orderkey = c.case_ord""")
def q_court_features(spark, d):
    cb = binding(spark, d, "cases_base").select(
        F.col("case_ord").alias("case_key"),
        F.array(F.col("o_totalprice") / 1e5, (F.col("year") - 1990) / 10.0).alias("vec"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_key"), *fx.VOTE_ORD)
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    mv = li.join(s, li.l_suppkey == s.s_suppkey).select(
        "case_key", F.struct(*fx.VOTE_ORD).alias("ord"),
        F.array(F.col("s_acctbal") / 1e4, F.col("s_nationkey") / 25.0).alias("vec"))
    feats = T.court_features(cb, mv, "case_key", "ord", "vec", dim=2, max_members=11)
    return feats.select("case_key", F.size("features").alias("n_features"), "justice_count",
                        F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 3).alias("feature_sum"))


# ---------------------------------------------------------------- token stores

shared("bio_token_keys", """
SELECT CASE WHEN member_ord % 2 = 0 THEN 'data' || chr(92) || 'tokens' || chr(92) || key || '.txt'
            ELSE 'data/tokens/' || key || '.txt' END AS key
FROM {bio_files} WHERE member_ord % 7 <> 3""")
shared("desc_token_keys", """
SELECT 'data/tokens/' || file_key || '.txt' AS key FROM {desc_files} WHERE file_ord % 5 <> 2""")
# the same stores with the texts that their tokens are made of
shared("bio_store_texts", """
SELECT CASE WHEN b.member_ord % 2 = 0 THEN 'data' || chr(92) || 'tokens' || chr(92) || b.key || '.txt'
            ELSE 'data/tokens/' || b.key || '.txt' END AS key, r.text AS text
FROM {bio_files} b JOIN {bios_raw} r ON r.member_ord = b.member_ord WHERE b.member_ord % 7 <> 3""")
shared("desc_store_texts", """
SELECT 'data/tokens/' || file_key || '.txt' AS key, min(text) AS text
FROM {desc_files} WHERE file_ord % 5 <> 2 GROUP BY file_key""")
define("bio_store", None, encode_sql("{bio_store_texts}", "key", "text"))
define("desc_store", None, encode_sql("{desc_store_texts}", "key", "text"))

BASE_SQL = "list_last(regexp_split_to_array(replace({x}, chr(92), '/'), '/'))"

define("tok_join", None, f"""
SELECT r.case_id, r.description,
  CAST(coalesce((SELECT count(DISTINCT {BASE_SQL.format(x='b')}) FROM (SELECT unnest(r.bios) AS b) u
                 WHERE {BASE_SQL.format(x='b')} IN (SELECT {BASE_SQL.format(x='key')} FROM {{bio_token_keys}})), 0)
       AS BIGINT) AS justice_count,
  {BASE_SQL.format(x='r.description')} IN (SELECT {BASE_SQL.format(x='key')} FROM {{desc_token_keys}}) AS has_d
FROM {{records}} r""")
define("tok_reason", None, """
SELECT case_id, description, justice_count,
  CASE WHEN description IS NULL THEN 'no description' WHEN NOT coalesce(has_d, false) THEN 'description not tokenized'
       WHEN justice_count = 0 THEN 'no valid justice biographies found' END AS reason FROM {tok_join}""")
define("tok_members", None, f"""
SELECT u.case_id, md5(string_agg(array_to_string(s.input_ids, ','), ';' ORDER BY u.pos)) AS members_md5
FROM (SELECT case_id, unnest(bios) AS b, generate_subscripts(bios, 1) AS pos FROM {{records}}) u
JOIN {{bio_store}} s ON {BASE_SQL.format(x='s.key')} = {BASE_SQL.format(x='u.b')} GROUP BY u.case_id""")


def token_join(spark, d):
    v = vocab(spark, d)
    # the stores are written, so that the texts' shuffle files are gone before the records are made
    encoded = lambda name: stored(T.tokenize_encode(binding(spark, d, name), "key", "text", v, 512), name)
    return T.join_tokens_by_basename(records_frame(spark, d), encoded("bio_store_texts"), encoded("desc_store_texts"))


@query("join_tokens_by_basename", sql=with_("records", "tok_reason", "tok_members", "vocab", "bio_store", "desc_store") + f"""
SELECT t.case_id, t.justice_count, CAST(len(s.input_ids) AS INT) AS n_case_ids,
       md5(array_to_string(s.input_ids, ',')) AS case_ids_md5, m.members_md5
FROM tok_reason t JOIN tok_members m ON m.case_id = t.case_id
JOIN desc_store s ON {BASE_SQL.format(x='s.key')} = {BASE_SQL.format(x='t.description')}
WHERE t.reason IS NULL""")
def q_join_tokens_by_basename(spark, d):
    kept, _ = token_join(spark, d)
    ids = F.array_join(F.transform("members", lambda m: F.array_join(m["input_ids"], ",")), ";")
    return kept.select("case_id", "justice_count", F.size("case_tokens.input_ids").alias("n_case_ids"),
                       F.md5(F.array_join("case_tokens.input_ids", ",")).alias("case_ids_md5"), F.md5(ids).alias("members_md5"))


@query("skip_reasons", sql=with_("records", "tok_reason") + """
SELECT reason, count(*) AS n FROM tok_reason WHERE reason IS NOT NULL GROUP BY reason""")
def q_skip_reasons(spark, d):
    _, skipped = token_join(spark, d)
    return skipped.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


shared("trunc_bios", """
SELECT b.member_ord, b.key || CASE b.member_ord % 4 WHEN 0 THEN '' WHEN 1 THEN '_v1' WHEN 2 THEN '-v2' ELSE '_x' END
         || '.txt' AS key
FROM {bio_files} b""")
# some full biographies are versioned themselves: those are matched exactly
shared("full_bios", """
SELECT member_ord, key || '.txt' AS key FROM {bio_files}
UNION ALL SELECT member_ord, key || '_v1.txt' AS key FROM {bio_files} WHERE member_ord % 8 = 1""")

define("pairs_resolved", None, """
SELECT t.key AS trunc_key, coalesce(f1.key, f2.key) AS full_key
FROM {trunc_bios} t LEFT JOIN {full_bios} f1 ON f1.key = t.key
LEFT JOIN {full_bios} f2 ON f2.key = regexp_replace(regexp_replace(t.key, '(?i)\\.txt$', ''), '[_\\-]v\\d+$', '') || '.txt'
WHERE coalesce(f1.key, f2.key) IS NOT NULL""")


def resolved(spark, d):
    return T.resolve_versioned_pair(binding(spark, d, "trunc_bios"), binding(spark, d, "full_bios"))


@query("resolve_versioned_pair", sql=with_("pairs_resolved") + "SELECT trunc_key, full_key FROM pairs_resolved")
def q_resolve_versioned_pair(spark, d):
    return resolved(spark, d)


define("pairs_enriched", None, """
SELECT p.trunc_key, p.full_key,
  TRY_CAST(nullif(regexp_extract(j.appointment_date, '(\\d{4})', 1), '') AS INTEGER) AS year, j.nominated_by AS president
FROM {pairs_resolved} p LEFT JOIN {justices} j
  ON j.name = replace(regexp_replace(regexp_replace(p.trunc_key, '(?i)\\.txt$', ''), '[_\\-]v\\d+$', ''), '_', ' ')""")


@query("enrich_with_metadata", sql=with_("pairs_enriched") + "SELECT trunc_key, full_key, year, president FROM pairs_enriched")
def q_enrich_with_metadata(spark, d):
    e = T.enrich_with_metadata(resolved(spark, d), binding(spark, d, "justices"))
    return e.select("trunc_key", "full_key", "year", "president")


# Texts: the truncated bio is the raw bio without its intro; the full bio is
# the raw text.  Keyed by the store names above.
shared("bio_texts", """
SELECT b.key, r.text FROM {full_bios} b JOIN {bios_raw} r ON r.member_ord = b.member_ord""")


define("trunc_texts", None, """
SELECT t.key AS key, b.text AS text FROM {trunc_bios} t
JOIN (SELECT member_ord, CASE WHEN regexp_matches(text, '(?m)^=== [^\\n]* ===$')
        THEN regexp_replace(substr(text, strpos(text, regexp_extract(text, '(?m)^=== [^\\n]* ===$', 0))),
                            '^[\\t\\n\\x0B\\f\\r ]+|[\\t\\n\\x0B\\f\\r ]+$', '', 'g')
        ELSE text END AS text FROM {bios_raw}) b ON b.member_ord = t.member_ord""")
define("trunc_tokens", None, encode_sql("{trunc_texts}", "key", "text"))
define("full_tokens", None, encode_sql("{bio_texts}", "key", "text"))


@query("pretraining_pairs", sql=with_("pairs_enriched", "bio_texts", "vocab", "trunc_tokens", "full_tokens") + """
SELECT p.trunc_key, p.full_key, p.year, p.president, t.n_tokens AS n_trunc_tokens, f.n_tokens AS n_full_tokens,
  CAST(len(t.input_ids) AS INT) AS n_trunc_ids, md5(array_to_string(t.input_ids, ',')) AS trunc_ids_md5,
  CAST(len(f.input_ids) AS INT) AS n_full_ids, md5(array_to_string(f.input_ids, ',')) AS full_ids_md5
FROM pairs_enriched p LEFT JOIN trunc_tokens t ON t.key = p.trunc_key LEFT JOIN full_tokens f ON f.key = p.full_key""")
def q_pretraining_pairs(spark, d):
    """Ids and masks of both texts, truncated to the configured length."""
    e = T.enrich_with_metadata(resolved(spark, d), binding(spark, d, "justices"))
    raw = binding(spark, d, "bios_raw").select("member_ord", "text")
    v = vocab(spark, d)
    tb = binding(spark, d, "trunc_bios").join(raw, "member_ord").select("key", S.drop_intro(F.col("text")).alias("text"))
    t, f = T.tokenize_encode(tb, "key", "text", v, 512), T.tokenize_encode(binding(spark, d, "bio_texts"), "key", "text", v, 512)
    j = T.pretraining_pairs(e, t, f)
    return j.select("trunc_key", "full_key", "year", "president", F.col("trunc.n_tokens").alias("n_trunc_tokens"),
                    F.col("full.n_tokens").alias("n_full_tokens"),
                    F.size("trunc.input_ids").alias("n_trunc_ids"), F.md5(F.array_join("trunc.input_ids", ",")).alias("trunc_ids_md5"),
                    F.size("full.input_ids").alias("n_full_ids"), F.md5(F.array_join("full.input_ids", ",")).alias("full_ids_md5"))
