"""Queries for array math, losses, classification metrics, vector metrics,
cluster studies and trial/epoch logs (SURVEY §2.3-2.6, §2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docket.functions import arrays as A
from docket.operators import metrics, vector_index, vectors
from docket.operators.decode import parse_share_sentinel
from docket.plans.bindings import binding, define, shared, with_
from docket.plans.q_cases import case_table
from docket.plans.registry import query
from docket.sources.tables import table

# ---------------------------------------------------------------- logits / targets

LOGITS_SQL = ("[o_totalprice / 1e5, CAST(o_custkey % 7 AS DOUBLE) / 3, CAST(case_ord % 5 AS DOUBLE) / 2]")


def logits_col():
    return F.array(F.col("o_totalprice") / 1e5, (F.col("o_custkey") % 7).cast("double") / 3,
                   (F.col("case_ord") % 5).cast("double") / 2)


def sm_sql(x: str) -> str:
    return (f"list_transform({x}, lambda v: exp(v - list_aggregate({x}, 'max')) / "
            f"list_sum(list_transform({x}, lambda w: exp(w - list_aggregate({x}, 'max')))))")


def lsm_sql(x: str) -> str:
    lse = f"(list_aggregate({x}, 'max') + ln(list_sum(list_transform({x}, lambda w: exp(w - list_aggregate({x}, 'max'))))))"
    return f"list_transform({x}, lambda v: v - {lse})"


define("lg", None, f"SELECT case_ord, {LOGITS_SQL} AS p FROM {{cases_base}}")


def logits_frame(spark, d):
    return binding(spark, d, "cases_base").select("case_ord", logits_col().alias("p"))


@query("softmax_probs", sql=with_("cases_base", "lg") + f"""
SELECT case_ord, round(q[1], 6) AS p0, round(q[2], 6) AS p1, round(q[3], 6) AS p2
FROM (SELECT case_ord, {sm_sql('p')} AS q FROM lg) t""")
def q_softmax_probs(spark, d):
    s = logits_frame(spark, d).select("case_ord", A.softmax(F.col("p")).alias("q"))
    return s.select("case_ord", *[F.round(F.col("q")[i], 6).alias(f"p{i}") for i in range(3)])


@query("argmax_class", sql=with_("cases_base", "lg") + """
SELECT case_ord, CAST(list_position(p, list_aggregate(p, 'max')) - 1 AS INT) AS cls FROM lg""")
def q_argmax_class(spark, d):
    return logits_frame(spark, d).select("case_ord", A.argmax(F.col("p")).alias("cls"))


define("rec_targets", None, """
SELECT r.case_id, cb.case_ord, CAST(floor(cb.case_ord / 32) AS BIGINT) AS batch,
       [r.t_in_favor, r.t_against, r.t_absent] AS t, """ + LOGITS_SQL.replace("case_ord", "cb.case_ord") + """ AS p
FROM {records} r JOIN {cases_base} cb ON cb.case_id = r.case_id""")


def rec_targets(spark, d):
    """Case id, ordinal, batch, target shares and logits: of the case table alone, no biographies or descriptions."""
    shares = [parse_share_sentinel(F.col(c).cast("string")) for c in ("pct_in_favor", "pct_against", "pct_absent")]
    r = case_table(spark, d).select(F.col("caseIssuesId").alias("case_id"), F.array(*shares).alias("t"))
    cb = binding(spark, d, "cases_base")
    j = r.join(cb, r.case_id == cb.case_id).select(r.case_id, cb.case_ord, cb.o_custkey, cb.o_totalprice, "t")
    return j.select("case_id", "case_ord", F.floor(F.col("case_ord") / 32).cast("long").alias("batch"), "t",
                    logits_col().alias("p"))


@query("normalize_target", sql=with_("records", "cases_base", "rec_targets") + """
SELECT case_id, round(t[1] / list_sum(t), 6) AS n0, round(t[2] / list_sum(t), 6) AS n1,
       round(t[3] / list_sum(t), 6) AS n2 FROM rec_targets""")
def q_normalize_target(spark, d):
    r = rec_targets(spark, d).select("case_id", A.normalize_target(F.col("t")).alias("n"))
    return r.select("case_id", *[F.round(F.col("n")[i], 6).alias(f"n{i}") for i in range(3)])


def kl_sql(p: str, t: str) -> str:
    tn = f"list_transform({t}, lambda x: x / list_sum({t}))"
    return (f"CASE WHEN list_aggregate({tn}, 'min') < 0 THEN NULL ELSE "
            f"list_sum(list_transform(list_zip({tn}, {lsm_sql(p)}), lambda z: "
            f"CASE WHEN z[1] = 0 THEN 0.0 ELSE z[1] * ln(z[1]) END - z[1] * z[2])) END")


define("kl_rows", None, f"SELECT batch, {kl_sql('p', 't')} AS kl FROM {{rec_targets}}")


@query("kl_loss", sql=with_("records", "cases_base", "rec_targets", "kl_rows") + """
SELECT batch, CASE WHEN count(kl) = count(*) THEN round(avg(kl), 6) END AS kl, count(*) AS n
FROM kl_rows GROUP BY batch""")
def q_kl_loss(spark, d):
    r = rec_targets(spark, d).withColumn("kl", A.kl_row(F.col("p"), F.col("t")))
    return r.groupBy("batch").agg(
        F.when(F.count("kl") == F.count(F.lit(1)), F.round(F.avg("kl"), 6)).alias("kl"), F.count(F.lit(1)).alias("n"))


@query("mse_loss", sql=with_("records", "cases_base", "rec_targets") + f"""
SELECT batch, round(sum(se) / (3 * count(*)), 6) AS mse, count(*) AS n FROM (
  SELECT batch, list_sum(list_transform(list_zip({sm_sql('p')}, t), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS se
  FROM rec_targets) s GROUP BY batch""")
def q_mse_loss(spark, d):
    r = rec_targets(spark, d).withColumn("se", A.squared_error_sum(F.col("p"), F.col("t")))
    return r.groupBy("batch").agg(F.round(F.sum("se") / (3 * F.count(F.lit(1))), 6).alias("mse"),
                                  F.count(F.lit(1)).alias("n"))


# Per-member 3-class logits/targets from lineitem (target one-hot by flag).
shared("member_dist", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  l_quantity / 50 AS p0, l_discount * 10 AS p1, l_tax * 10 AS p2,
  CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS t0, CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END AS t1,
  CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END AS t2
FROM {lineitem}""")


@query("kl_per_member", sql=with_("member_dist") + f"""
SELECT l_orderkey, round(avg(k), 6) AS kl_mean, round(sum(k), 6) AS kl_sum, count(*) AS n FROM (
  SELECT l_orderkey, list_sum(list_transform(list_zip(list_transform(t, lambda x: x / greatest(list_sum(t), 1e-12)),
           {lsm_sql('p')}), lambda z: z[1] * (ln(greatest(z[1], 1e-12)) - z[2]))) AS k
  FROM (SELECT l_orderkey, [p0, p1, p2] AS p, [t0, t1, t2] AS t FROM member_dist) m) s GROUP BY l_orderkey""")
def q_kl_per_member(spark, d):
    m = binding(spark, d, "member_dist").select("l_orderkey", F.array("p0", "p1", "p2").alias("p"),
                                                F.array("t0", "t1", "t2").alias("t"))
    m = m.withColumn("k", A.kl_row_clamped(F.col("p"), F.col("t")))
    return m.groupBy("l_orderkey").agg(F.round(F.avg("k"), 6).alias("kl_mean"), F.round(F.sum("k"), 6).alias("kl_sum"),
                                       F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- classification

shared("class_pairs", """
SELECT l.doc_id, CAST(l.quality + l.toxic AS INT) AS y_true, CAST(d.n_chars % 3 AS INT) AS y_pred
FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id""")


@query("confusion_matrix", sql=with_("class_pairs") + """
SELECT g.true_class, coalesce(count_if(y_pred = 0), 0) AS pred_0, coalesce(count_if(y_pred = 1), 0) AS pred_1,
       coalesce(count_if(y_pred = 2), 0) AS pred_2, count_if(p.y_true IS NOT NULL AND coalesce(y_pred NOT IN (0, 1, 2), true)) AS pred_other
FROM (SELECT CAST(unnest(range(3)) AS INT) AS true_class UNION SELECT y_true FROM class_pairs) g
LEFT JOIN class_pairs p ON p.y_true = g.true_class GROUP BY g.true_class""")
def q_confusion_matrix(spark, d):
    return metrics.confusion_matrix(binding(spark, d, "class_pairs"), "y_true", "y_pred", 3)


def f1_sql():
    parts = []
    for c in range(3):
        tp, t, p = (f"count_if(y_true = {c} AND y_pred = {c})", f"count_if(y_true = {c})", f"count_if(y_pred = {c})")
        parts.append(f"CASE WHEN {t} = 0 AND {p} = 0 THEN 1.0 WHEN {t} = 0 OR {p} = 0 THEN 0.0 "
                     f"ELSE 2.0 * {tp} / ({t} + {p}) END")
    return parts


F1_PARTS = f1_sql()
F1_SQL = (", ".join(f"round({x}, 6) AS f1_{c}" for c, x in enumerate(F1_PARTS))
          + f", round(({' + '.join(F1_PARTS)}) / 3, 6) AS f1_macro")


@query("f1_macro", sql=with_("class_pairs") + f"SELECT {F1_SQL} FROM class_pairs")
def q_f1_macro(spark, d):
    return metrics.f1_macro(binding(spark, d, "class_pairs"), "y_true", "y_pred", 3)


def f1_over(t: str, p: str) -> str:
    return F1_MACRO.replace("y_true", t).replace("y_pred", p)


F1_MACRO = f"({' + '.join(F1_PARTS)}) / 3"

define("scored", None, "SELECT batch, " + kl_sql("p", "t") + """ AS kl,
  CAST(list_position(t, list_aggregate(t, 'max')) - 1 AS INT) AS y_true,
  CAST(list_position(p, list_aggregate(p, 'max')) - 1 AS INT) AS y_pred FROM {rec_targets}""")


@query("combined_metric", sql=with_("records", "cases_base", "rec_targets", "scored") + f"""
SELECT round((kl + 1 - f1) / 2, 6) AS combined, round(kl, 6) AS kl, round(f1, 6) AS f1, n, n_undefined FROM (
  SELECT (SELECT avg(m) FROM (SELECT avg(kl) AS m FROM scored GROUP BY batch) b) AS kl,
         (SELECT {F1_MACRO} FROM scored) AS f1, (SELECT count(*) FROM scored) AS n,
         (SELECT count(*) FROM scored WHERE kl IS NULL) AS n_undefined) t""")
def q_combined_metric(spark, d):
    """KL and F1 over the same scored records; records whose KL is not
    defined (a negative share) are counted, not passed over in silence."""
    r = rec_targets(spark, d).select("batch", A.kl_row(F.col("p"), F.col("t")).alias("kl"),
                                     A.argmax(F.col("t")).alias("y_true"), A.argmax(F.col("p")).alias("y_pred"))
    return metrics.combined_metric(r, "batch", "kl", "y_true", "y_pred", 3)


# ---------------------------------------------------------------- vectors

def nz_sql(x: str) -> str:
    return f"list_transform({x}, lambda v: v / greatest(sqrt(list_inner_product({x}, {x})), 1e-12))"


define("pv", None, f"""
SELECT vec_id, label, CAST(floor(vec_id / 16) AS BIGINT) AS batch,
  {nz_sql("list_transform(embedding[1:32], lambda v: CAST(v AS DOUBLE))")} AS s,
  {nz_sql("list_transform(embedding[33:64], lambda v: CAST(v AS DOUBLE))")} AS t,
  {nz_sql("list_transform(embedding, lambda v: CAST(v AS DOUBLE))")} AS u
FROM {{embeddings}}""")


def pair_vectors(spark, d):
    e = table(spark, d, "embeddings")
    v = A.as_double(F.col("embedding"))
    return e.select("vec_id", "label", F.floor(F.col("vec_id") / 16).cast("long").alias("batch"),
                    A.l2_normalize(F.slice(v, 1, 32)).alias("s"), A.l2_normalize(F.slice(v, 33, 32)).alias("t"),
                    A.l2_normalize(v).alias("u"))


@query("l2_normalize", sql=with_("pv") + """
SELECT vec_id, CAST(len(u) AS INT) AS n_dims, round(list_sum(u), 6) AS total, round(u[1], 6) AS first,
       round(sqrt(list_inner_product(u, u)), 6) AS norm FROM pv""")
def q_l2_normalize(spark, d):
    p = pair_vectors(spark, d)
    return p.select("vec_id", F.size("u").alias("n_dims"), F.round(A.asum(F.col("u")), 6).alias("total"),
                    F.round(F.col("u")[0], 6).alias("first"), F.round(A.norm(F.col("u")), 6).alias("norm"))


@query("cosine_pair_loss", sql=with_("pv") + """
SELECT batch, round(1 - avg(list_inner_product(s, t) / (greatest(sqrt(list_inner_product(s, s)), 1e-8)
       * greatest(sqrt(list_inner_product(t, t)), 1e-8))), 6) AS cos_loss FROM pv GROUP BY batch""")
def q_cosine_pair_loss(spark, d):
    c = vectors.cosine_pair_loss(pair_vectors(spark, d), "batch", "s", "t")
    return c.select("batch", F.round("cos_loss", 6).alias("cos_loss"))


NT_SQL = """
SELECT a.batch, avg(-(a.pos - ln(exp(a.pos) + a.neg))) AS nt_xent, count(*) AS n FROM (
  SELECT x.batch, x.vec_id, list_inner_product(x.s, x.t) / 0.5 AS pos,
         sum(CASE WHEN y.vec_id <> x.vec_id THEN exp(list_inner_product(x.s, y.t) / 0.5) ELSE 0 END) AS neg
  FROM {pv} x JOIN {pv} y ON x.batch = y.batch GROUP BY x.batch, x.vec_id, x.s, x.t) a GROUP BY a.batch"""
define("nt", None, NT_SQL)


@query("nt_xent", sql=with_("pv", "nt") + "SELECT batch, round(nt_xent, 6) AS nt_xent, n FROM nt")
def q_nt_xent(spark, d):
    n = vectors.nt_xent(pair_vectors(spark, d), "batch", "vec_id", "s", "t", temperature=0.5)
    return n.select("batch", F.round("nt_xent", 6).alias("nt_xent"), "n")


@query("nt_xent_scaled", sql=with_("pv") + """
SELECT a.batch, round(avg(-(a.pos - ln(exp(a.pos) + greatest((1 - 0.1) * a.neg, 1e-12)))), 6) AS nt_xent, count(*) AS n FROM (
  SELECT x.batch, x.vec_id, list_inner_product(x.s, x.t) / 0.5 AS pos,
         sum(CASE WHEN y.vec_id <> x.vec_id THEN exp(list_inner_product(x.s, y.t) / 0.5) ELSE 0 END) AS neg
  FROM pv x JOIN pv y ON x.batch = y.batch GROUP BY x.batch, x.vec_id, x.s, x.t) a GROUP BY a.batch""")
def q_nt_xent_scaled(spark, d):
    """NT-Xent with the share rho of the negatives taken off."""
    n = vectors.nt_xent(pair_vectors(spark, d), "batch", "vec_id", "s", "t", temperature=0.5, rho=0.1)
    return n.select("batch", F.round("nt_xent", 6).alias("nt_xent"), "n")


@query("contrastive_loss", sql=with_("pv", "nt") + """
SELECT n.batch, round(0.5 * n.nt_xent + 0.5 * c.cl, 6) AS loss FROM nt n JOIN (
  SELECT batch, 1 - avg(list_inner_product(s, t) / (greatest(sqrt(list_inner_product(s, s)), 1e-8)
         * greatest(sqrt(list_inner_product(t, t)), 1e-8))) AS cl FROM pv GROUP BY batch) c ON c.batch = n.batch""")
def q_contrastive_loss(spark, d):
    return vectors.contrastive_loss(pair_vectors(spark, d), "batch", "vec_id", "s", "t", 0.5, 0.5, 0.0)


def query_set(p):
    """The stated query set of the searches: every row whose id is divisible by 100."""
    return p.filter(F.col("vec_id") % 100 == 0)


@query("mrr", sql=with_("pv") + """
SELECT round(avg(1.0 / rnk), 6) AS mrr, count(*) AS n FROM (
  SELECT x.vec_id, 1 + count_if(round(list_inner_product(x.s, y.t), 9) > round(list_inner_product(x.s, x.t), 9)) AS rnk
  FROM pv x JOIN pv y ON x.vec_id % 100 = 0 GROUP BY x.vec_id) r""")
def q_mrr(spark, d):
    """Own teachers of the query set ranked among the teachers of the whole validation set."""
    p = pair_vectors(spark, d).select("vec_id", "s", "t")
    return vector_index.mrr(query_set(p), p, "vec_id", "s", "t")


@query("similarity_cross_join", sql=with_("pv") + """
SELECT x.vec_id AS qid, y.vec_id AS cid, round(list_inner_product(x.u, y.u), 6) AS sim
FROM pv x JOIN pv y ON x.vec_id % 100 = 0 AND x.vec_id <> y.vec_id AND round(list_inner_product(x.u, y.u), 9) >= 0.3""")
def q_similarity_cross_join(spark, d):
    p = pair_vectors(spark, d).select("vec_id", "u")
    s = vector_index.at_least(query_set(p), p, "vec_id", "u", threshold=0.3)
    return s.select("qid", "cid", F.round("sim", 6).alias("sim"))


define("cl", None, "SELECT vec_id, label, u FROM {pv} WHERE label <> 9")
define("cent", None, """
SELECT label, list(m ORDER BY i) AS c FROM (
  SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM {cl}) e
  GROUP BY label, i) g GROUP BY label""")


def clustered(spark, d):
    return pair_vectors(spark, d).filter(F.col("label") != 9).select("vec_id", "label", "u")


COS_SQL = ("list_inner_product({a}, {b}) / (greatest(sqrt(list_inner_product({a}, {a})), 1e-8) * "
           "greatest(sqrt(list_inner_product({b}, {b})), 1e-8))")


@query("cluster_cohesion", sql=with_("pv", "cl", "cent") + f"""
SELECT label, count(*) AS size, round(avg(dd), 6) AS mean_cos_dist, round(median(dd), 6) AS median_cos_dist,
       round(max(dd), 6) AS max_cos_dist
FROM (SELECT cl.label, 1 - {COS_SQL.format(a='cl.u', b='cent.c')} AS dd FROM cl JOIN cent ON cent.label = cl.label) t
GROUP BY label""")
def q_cluster_cohesion(spark, d):
    return vectors.cluster_cohesion(clustered(spark, d), "label", "u", 64)


@query("centroid_similarity", sql=with_("pv", "cl", "cent") + f"""
SELECT cluster_a, cluster_b, round(cos, 6) AS cos FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster_a ORDER BY cos DESC, cluster_b) AS k FROM (
    SELECT a.label AS cluster_a, b.label AS cluster_b, round({COS_SQL.format(a='a.c', b='b.c')}, 9) AS cos FROM cent a, cent b) p) t
WHERE k <= 5""")
def q_centroid_similarity(spark, d):
    return vectors.centroid_similarity(clustered(spark, d), "label", "u", 64)


def nn_fmt_sql():
    return """
SELECT qid, string_agg('vec_' || CAST(id AS VARCHAR) || ' [' || CASE WHEN lbl = 9 THEN '—' ELSE CAST(lbl AS VARCHAR) END
                       || '] (cos=' || printf('%.3f', -neg) || ')', '; ' ORDER BY neg, id) AS nearest_neighbors_top5
FROM (SELECT x.vec_id AS qid, y.vec_id AS id, y.label AS lbl, -round(list_inner_product(x.u, y.u), 9) AS neg,
             row_number() OVER (PARTITION BY x.vec_id ORDER BY -round(list_inner_product(x.u, y.u), 9), y.vec_id) AS k
      FROM pv x, pv y WHERE x.vec_id % 100 = 0 AND x.vec_id <> y.vec_id) t
WHERE k <= 5 GROUP BY qid"""


@query("top_k_neighbors", sql=with_("pv") + nn_fmt_sql())
def q_top_k_neighbors(spark, d):
    p = pair_vectors(spark, d).select("vec_id", "u", "label")
    nn = vector_index.nearest(query_set(p), p.select("vec_id", "u"), "vec_id", "u", k=5)
    lab = p.select(F.col("vec_id").alias("cid"), F.col("label").alias("clabel"))
    item = F.struct((-F.col("sim")).alias("neg"), F.col("cid").alias("id"), F.col("clabel").alias("label"))
    top = nn.join(lab, "cid").groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("top"))
    fmt = F.transform("top", lambda c: F.concat(
        F.lit("vec_"), c["id"].cast("string"), F.lit(" ["),
        F.when(c["label"] == 9, F.lit("—")).otherwise(c["label"].cast("string")),
        F.lit("] (cos="), F.format_string("%.3f", -c["neg"]), F.lit(")")))
    return top.select("qid", F.array_join(fmt, "; ").alias("nearest_neighbors_top5"))


# ---------------------------------------------------------------- batches, trials, epochs

@query("mean_of_batch_means", sql="""
SELECT round(avg(m), 6) AS loss, count(*) AS n_batches FROM (
  SELECT floor(event_id / 32) AS b, avg(value) AS m FROM events GROUP BY 1) t""")
def q_mean_of_batch_means(spark, d):
    e = table(spark, d, "events").select(F.floor(F.col("event_id") / 32).alias("b"), "value")
    return metrics.mean_of_batch_means(e, "b", "value")


def fold_log(spark, d):
    e = table(spark, d, "events")
    done = F.col("event_type") != "error"
    return (e.groupBy(F.col("user_id").alias("trial"), (F.col("event_id") % 3).alias("fold"))
            .agg(F.avg(F.when(done, F.col("value"))).alias("metric"), (F.count_if(done) > 0).alias("completed")))


@query("cv_fold_mean", sql="""
SELECT trial, round(coalesce(avg(CASE WHEN completed THEN metric END), 10.0), 6) AS cv_mean,
       count_if(completed) AS n_completed FROM (
  SELECT user_id AS trial, event_id % 3 AS fold, avg(CASE WHEN event_type <> 'error' THEN value END) AS metric,
         count_if(event_type <> 'error') > 0 AS completed FROM events GROUP BY 1, 2) f GROUP BY trial""")
def q_cv_fold_mean(spark, d):
    return metrics.cv_fold_mean(fold_log(spark, d), "trial", "metric", F.col("completed"), 10.0)


@query("cv_fold_mean_pretraining", sql="""
SELECT trial, round(coalesce(avg(CASE WHEN completed THEN metric END), 0.0), 6) AS cv_mean,
       count_if(completed) AS n_completed FROM (
  SELECT user_id AS trial, event_id % 3 AS fold, avg(CASE WHEN event_type = 'purchase' THEN value END) AS metric,
         count_if(event_type = 'purchase') > 0 AS completed FROM events GROUP BY 1, 2) f GROUP BY trial""")
def q_cv_fold_mean_pretraining(spark, d):
    """The pretraining tuner's variant: 0.0 for a trial without a completed fold."""
    done = F.col("event_type") == "purchase"
    log = (table(spark, d, "events").groupBy(F.col("user_id").alias("trial"), (F.col("event_id") % 3).alias("fold"))
           .agg(F.avg(F.when(done, F.col("value"))).alias("metric"), (F.count_if(done) > 0).alias("completed")))
    return metrics.cv_fold_mean(log, "trial", "metric", F.col("completed"), 0.0)


TRIALS_SQL = """(SELECT user_id AS trial, arg_max(event_type, (ts, event_id)) AS state, avg(value) AS value
                 FROM events GROUP BY user_id)"""


def trials(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("trial")).agg(
        F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.avg("value").alias("value"))


@query("trial_summary", sql=f"""
SELECT state, count(*) AS n, arg_min(trial, (value, trial)) AS best_trial, round(min(value), 6) AS best_value
FROM {TRIALS_SQL} t GROUP BY state""")
def q_trial_summary(spark, d):
    return metrics.trial_summary(trials(spark, d), "state", "value", "trial")


@query("best_trial", sql=f"""
SELECT arg_min(trial, (value, trial)) AS trial, round(arg_min(value, (value, trial)), 6) AS value FROM {TRIALS_SQL} t""")
def q_best_trial(spark, d):
    return metrics.best_trial(trials(spark, d), "trial", "value")


def epoch_log(spark, d):
    """Epoch = position of the event in its user's (ts, event_id) order,
    from one global rank minus the user's first rank (no per-user window)."""
    from docket.operators.splits import global_rank
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "value")
    r = global_rank(e, [F.col("user_id").asc(), F.col("ts").asc(), F.col("event_id").asc()])
    first = r.groupBy("user_id").agg(F.min("rn").alias("__first"))
    return r.join(first, "user_id").select("user_id", (F.col("rn") - F.col("__first")).alias("epoch"), "value")


def early_sql(patience: int, only_even: bool, min_epochs: int) -> str:
    counted = "epoch % 2 = 0" if only_even else "TRUE"
    return f"""
WITH lg AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS epoch, value
            FROM events),
c AS (SELECT * FROM lg WHERE {counted}),
i AS (SELECT *, min(value) OVER (PARTITION BY user_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
              AS prev FROM c),
i2 AS (SELECT *, prev IS NULL OR value < prev AS imp,
              count(*) OVER (PARTITION BY user_id ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS k FROM i),
i3 AS (SELECT *, max(CASE WHEN imp THEN k END) OVER (PARTITION BY user_id ORDER BY epoch ROWS UNBOUNDED PRECEDING)
              AS lk FROM i2),
s AS (SELECT i3.user_id, min(CASE WHEN k - lk >= {patience} AND epoch >= {min_epochs} THEN epoch END) AS fs,
             (SELECT max(epoch) FROM lg WHERE lg.user_id = i3.user_id) AS last FROM i3 GROUP BY i3.user_id)
SELECT s.user_id, coalesce(fs, last) AS stop_epoch, max(i3.epoch) AS best_epoch,
       round(arg_max(i3.value, i3.epoch), 6) AS best_value, fs IS NOT NULL AS stopped
FROM s JOIN i3 ON i3.user_id = s.user_id
WHERE i3.imp AND i3.epoch <= coalesce(fs, last) GROUP BY s.user_id, fs, last"""


@query("early_stop_epoch", sql=early_sql(3, False, 0))
def q_early_stop_epoch(spark, d):
    return metrics.early_stop(epoch_log(spark, d), ["user_id"], "epoch", "value", patience=3)


@query("early_stop_every_other", sql=early_sql(2, True, 4))
def q_early_stop_every_other(spark, d):
    return metrics.early_stop(epoch_log(spark, d), ["user_id"], "epoch", "value", patience=2, only_even=True,
                              min_epochs=4)
