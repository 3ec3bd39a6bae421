"""Queries for holdout, splits, folds, ordering and set operations
(SURVEY §2.3, §2.5-2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docket.functions import strings as S
from docket.operators import setops, splits
from docket.operators.text import dedup_first
from docket.plans.bindings import binding, define, shared, with_
from docket.plans.registry import query
from docket.sources import fixtures as fx
from docket.sources.tables import table

# Cases as the split functions see them: id, ordinal, year from the id,
# whether a description resolves.
shared("case_keys", """
SELECT cb.case_id, cb.case_ord, dk.file_key IS NOT NULL AS has_desc
FROM {cases_base} cb LEFT JOIN {desc_keys} dk ON dk.file_key = replace(cb.usCite, ' ', '_')""")

YEAR_SQL = "coalesce(TRY_CAST(substr(case_id, 1, 4) AS INTEGER), 0)"


def case_keys(spark, d):
    return binding(spark, d, "case_keys").withColumn("year", S.year_from_id(F.col("case_id")))


define("ck", None, f"SELECT *, {YEAR_SQL} AS year FROM {{case_keys}}")
define("holdout", None, """
SELECT case_id, year, rn FROM (
  SELECT case_id, year, row_number() OVER (ORDER BY year DESC, case_ord) AS rn,
         count(*) OVER () AS n FROM {ck} WHERE has_desc) t
WHERE rn <= floor(n * 0.15)""")


def holdout(spark, d):
    return splits.holdout_most_recent(case_keys(spark, d).filter("has_desc"), "year", "case_ord", 0.15)


@query("holdout_most_recent", sql=with_("holdout") + "SELECT case_id, year, rn FROM holdout")
def q_holdout_most_recent(spark, d):
    return holdout(spark, d).select("case_id", "year", "rn")


@query("holdout_semi_anti", sql=with_("ck", "holdout") + """
SELECT case_id, 'holdout' AS part FROM ck WHERE case_id IN (SELECT case_id FROM holdout)
UNION ALL
SELECT case_id, 'available' AS part FROM ck WHERE case_id NOT IN (SELECT case_id FROM holdout)""")
def q_holdout_semi_anti(spark, d):
    ck = case_keys(spark, d)
    h = holdout(spark, d).select(F.col("case_id").alias("__h"))
    only = ck.join(h, ck.case_id == h.__h, "left_semi").select("case_id", F.lit("holdout").alias("part"))
    excl = ck.join(h, ck.case_id == h.__h, "left_anti").select("case_id", F.lit("available").alias("part"))
    return only.unionByName(excl)


define("train_val", None, """
SELECT case_id, rn, CASE WHEN rn <= floor(n * (0.85 / (0.85 + 0.15))) THEN 'train' ELSE 'val' END AS role FROM (
  SELECT case_id, row_number() OVER (ORDER BY year, case_ord) AS rn, count(*) OVER () AS n
  FROM {ck} WHERE case_id NOT IN (SELECT case_id FROM {holdout})
    AND ((SELECT min(year) FROM {holdout} WHERE year > 0) IS NULL
         OR year < (SELECT min(year) FROM {holdout} WHERE year > 0))) t""")


def train_val(spark, d):
    return splits.split_time_train_val(case_keys(spark, d), holdout(spark, d), "case_id", "year", "case_ord")


@query("split_time_train_val", sql=with_("train_val") + "SELECT case_id, rn, role FROM train_val")
def q_split_time_train_val(spark, d):
    return train_val(spark, d).select("case_id", "rn", "role")


@query("holdout_overlap_check", sql=with_("train_val") + """
SELECT count(*) AS n_overlap FROM (SELECT case_id FROM train_val INTERSECT SELECT case_id FROM holdout) t""")
def q_holdout_overlap_check(spark, d):
    tv = train_val(spark, d).select("case_id")
    return setops.overlap_count(tv, holdout(spark, d).select("case_id"))


@query("split_time_70_15_15", sql=with_("ck") + """
SELECT case_id, rn, CASE WHEN rn <= floor(n * 0.7) THEN 'train' WHEN rn <= floor(n * 0.7) + floor(n * 0.15) THEN 'val'
                         ELSE 'test' END AS role
FROM (SELECT case_id, row_number() OVER (ORDER BY year, case_ord) AS rn, count(*) OVER () AS n
      FROM ck WHERE year BETWEEN 1996 AND 2000) t""")
def q_split_time_70_15_15(spark, d):
    from docket.operators.filters import filter_year_range
    ck = filter_year_range(case_keys(spark, d), "year", 1996, 2000)
    return splits.split_time_ratios(ck, "year", "case_ord").select("case_id", "rn", "role")


define("pretrain_years", None, """
SELECT member_ord, TRY_CAST(nullif(regexp_extract(appointment_date, '(\\d{4})', 1), '') AS INTEGER) AS year
FROM {justices}""")


def pretrain_years(spark, d):
    j = binding(spark, d, "justices")
    return j.select("member_ord", S.year_from_text(F.col("appointment_date")).alias("year"))


@query("split_tail_counts", sql=with_("pretrain_years") + """
SELECT member_ord, rn, CASE WHEN n - rn + 1 <= 10 THEN 'test' WHEN n - rn + 1 <= 20 THEN 'val' ELSE 'train' END AS role
FROM (SELECT member_ord, row_number() OVER (ORDER BY coalesce(year, 0), member_ord) AS rn, count(*) OVER () AS n
      FROM pretrain_years) t""")
def q_split_tail_counts(spark, d):
    return splits.split_tail_counts(pretrain_years(spark, d), "year", "member_ord", 10, 10) \
        .select("member_ord", "rn", "role")


@query("split_random", sql=with_("ck") + """
SELECT case_id, rn, CASE WHEN rn <= floor(n * 0.85) THEN 'train' ELSE 'val' END AS role FROM (
  SELECT case_id, row_number() OVER (ORDER BY ('0x' || substr(md5(case_id || '|42'), 1, 8))::UBIGINT, case_id) AS rn,
         count(*) OVER () AS n FROM ck) t""")
def q_split_random(spark, d):
    return splits.split_random(case_keys(spark, d), "case_id", 42, 0.85).select("case_id", "rn", "role")


@query("cv_forward_folds", sql=with_("ck", "holdout") + """
SELECT case_id, CAST(floor((rn - 1) / s) AS INT) AS fold, CASE WHEN (rn - 1) % s < t THEN 'train' ELSE 'val' END AS role
FROM (SELECT *, floor(n * 0.25) AS t, floor(n * 0.25) + floor(n * 0.05) AS s FROM (
  SELECT case_id, row_number() OVER (ORDER BY year, case_ord) AS rn, count(*) OVER () AS n
  FROM ck WHERE has_desc AND case_id NOT IN (SELECT case_id FROM holdout)) r) t
WHERE s > 0 AND floor((rn - 1) / s) < least(3, floor(n / s))""")
def q_cv_forward_folds(spark, d):
    ck = case_keys(spark, d)
    h = holdout(spark, d).select(F.col("case_id").alias("__h"))
    avail = ck.filter("has_desc").join(h, ck.case_id == h.__h, "left_anti")
    return splits.cv_forward_folds(avail, "year", "case_ord", 0.25, 0.05, 3).select("case_id", "fold", "role")


@query("cv_backward_folds", sql=with_("pretrain_years") + """
SELECT member_ord, fold, role FROM (
  SELECT p.member_ord, f.fold,
    CASE WHEN p.rn - 1 >= f.vs AND p.rn - 1 < f.ve THEN 'val'
         WHEN p.rn - 1 >= f.ts AND p.rn - 1 < f.te THEN 'train' END AS role
  FROM (SELECT member_ord, row_number() OVER (ORDER BY coalesce(year, 0), member_ord) AS rn FROM pretrain_years) p,
       (SELECT fold, vs, ve, ts, te FROM (
          SELECT fold, vs, ve, greatest(0, vs - 40) AS ts, vs AS te,
                 min(CASE WHEN greatest(0, vs - 40) >= vs OR vs >= ve THEN fold END) OVER () AS stop
          FROM (SELECT CAST(i AS INT) AS fold, greatest(0, u - i * 10 - 10) AS vs, u - i * 10 AS ve
                FROM range(5) r(i), (SELECT greatest(count(*) - 10, 0) AS u FROM pretrain_years) c) a) b
        WHERE fold < coalesce(stop, 5)) f) t
WHERE role IS NOT NULL""")
def q_cv_backward_folds(spark, d):
    return splits.cv_backward_folds(pretrain_years(spark, d), "year", "member_ord", test_size=10,
                                    train_size=40, val_size=10, n_folds=5, fallback_val=10) \
        .select("member_ord", "fold", "role")


@query("fold_cycle", sql="""
SELECT user_id AS trial, CAST(user_id % 3 AS INT) AS fold FROM (SELECT DISTINCT user_id FROM events) t""")
def q_fold_cycle(spark, d):
    t = table(spark, d, "events").select(F.col("user_id").alias("trial")).distinct()
    return splits.fold_cycle(t, "trial", 3)


@query("batch_ids", sql="""
SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 16) AS BIGINT) AS batch FROM documents""")
def q_batch_ids(spark, d):
    t = table(spark, d, "documents").select("doc_id")
    return splits.batch_ids(t, [F.col("doc_id").asc()], 16).select("doc_id", "batch")


@query("sort_by_year_stable", sql=with_("ck") + """
SELECT case_id, row_number() OVER (ORDER BY year, case_ord) AS rn_asc,
       row_number() OVER (ORDER BY year DESC, case_ord) AS rn_desc FROM ck""")
def q_sort_by_year_stable(spark, d):
    ck = case_keys(spark, d).select("case_id", "year", "case_ord")
    return splits.year_ranks(ck, "year", "case_ord").select("case_id", "rn_asc", "rn_desc")


@query("first_row_per_group", sql=with_("votes") + """
SELECT caseIssuesId, arg_min(justiceName, (ORD)) AS first_member, arg_min(vote, (ORD)) AS first_vote
FROM votes GROUP BY caseIssuesId""".replace("ORD", ", ".join(fx.VOTE_ORD)))
def q_first_row_per_group(spark, d):
    v = fx.votes(spark, d, keep_order_key=True)
    o = F.struct(*[F.col(c) for c in fx.VOTE_ORD])
    return (v.groupBy("l_orderkey", "caseIssuesId")
            .agg(F.min_by(F.struct("justiceName", "vote"), o).alias("f"))
            .select("caseIssuesId", F.col("f.justiceName").alias("first_member"), F.col("f.vote").alias("first_vote")))


@query("limit_first_n", sql=with_("dedup_cites") + """
SELECT usCite, case_ord FROM (
  SELECT usCite, min(case_ord) AS case_ord FROM dedup_cites GROUP BY usCite) t ORDER BY case_ord LIMIT 10""")
def q_limit_first_n(spark, d):
    c = binding(spark, d, "dedup_cites")
    firsts = dedup_first(c.select("usCite", "case_ord"), ["usCite"], ["case_ord"])
    return firsts.orderBy("case_ord").limit(10)


@query("longest_candidate", sql="""
SELECT conv_id, arg_max(turn, (length(text), -turn)) AS turn, max(length(text)) AS n_chars
FROM conversations GROUP BY conv_id""")
def q_longest_candidate(spark, d):
    c = table(spark, d, "conversations")
    best = c.groupBy("conv_id").agg(F.max_by(F.struct("turn", F.length("text").alias("n")),
                                             F.struct(F.length("text"), -F.col("turn"))).alias("b"))
    return best.select("conv_id", F.col("b.turn").alias("turn"), F.col("b.n").alias("n_chars"))


# ---------------------------------------------------------------- set operations

# Already-encoded description keys (the "done" set) and the required set.
shared("done_keys", """
SELECT replace(cb.usCite, ' ', '_') AS key FROM {cases_base} cb
WHERE cb.case_ord % 3 <> 0 AND cb.usCite IS NOT NULL""")
shared("required_keys", """
SELECT DISTINCT replace(usCite, ' ', '_') AS key FROM {cases_base}
WHERE usCite IS NOT NULL AND case_ord % 2 = 0""")


@query("pending_work", sql=with_("required_keys", "done_keys", "desc_keys") + """
SELECT key, CASE WHEN key IN (SELECT file_key FROM desc_keys) THEN 'existing' ELSE 'missing' END AS status
FROM (SELECT key FROM required_keys EXCEPT SELECT key FROM done_keys) p""")
def q_pending_work(spark, d):
    req = binding(spark, d, "required_keys")
    done = binding(spark, d, "done_keys")
    have = binding(spark, d, "desc_keys").select(F.col("file_key").alias("key"))
    return setops.pending_work(req, done, have, "key")


@query("coverage_intersection", sql=with_("required_keys", "done_keys") + """
SELECT count(*) AS n_required, (SELECT count(*) FROM (SELECT key FROM required_keys INTERSECT SELECT key FROM done_keys) i)
  AS n_done, round(CAST((SELECT count(*) FROM (SELECT key FROM required_keys INTERSECT SELECT key FROM done_keys) i) AS DOUBLE)
                   / count(*), 6) AS coverage
FROM required_keys""")
def q_coverage_intersection(spark, d):
    return setops.coverage_intersection(binding(spark, d, "required_keys"), binding(spark, d, "done_keys"), "key")


# Store increments: existing rows for doc_id % 3 <> 0, new rows (changed
# text) for even doc_ids; new wins.
shared("store_old", "SELECT doc_id AS key, text FROM {documents} WHERE doc_id % 4 <> 0")
shared("store_new", "SELECT doc_id AS key, text || ' [rev]' AS text FROM {documents} WHERE doc_id % 2 = 0")


@query("upsert_new_wins", sql=with_("store_old", "store_new") + """
SELECT key, 'new' AS src, length(text) AS n_chars, md5(text) AS h FROM store_new
UNION ALL
SELECT key, 'old' AS src, length(text) AS n_chars, md5(text) AS h FROM store_old
WHERE key NOT IN (SELECT key FROM store_new)""")
def q_upsert_new_wins(spark, d):
    m = setops.upsert_new_wins(binding(spark, d, "store_old"), binding(spark, d, "store_new"), ["key"])
    return m.select("key", "src", F.length("text").alias("n_chars"), F.md5("text").alias("h"))


@query("year_span", sql=with_("ck") + """
SELECT role, coalesce(CAST(min(CASE WHEN year > 0 THEN year END) AS VARCHAR) || '-'
                      || CAST(max(CASE WHEN year > 0 THEN year END) AS VARCHAR), 'N/A') AS span, count(*) AS n
FROM (SELECT year, CASE WHEN rn <= floor(n * 0.7) THEN 'train' WHEN rn <= floor(n * 0.7) + floor(n * 0.15) THEN 'val'
                        ELSE 'test' END AS role
      FROM (SELECT year, row_number() OVER (ORDER BY year, case_ord) AS rn, count(*) OVER () AS n
            FROM ck) t) s
GROUP BY role""")
def q_year_span(spark, d):
    from docket.operators.reports import year_span
    return year_span(splits.split_time_ratios(case_keys(spark, d), "year", "case_ord"), ["role"], "year")
