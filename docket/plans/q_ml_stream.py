"""Queries for the ML re-aims and the incremental/streaming jobs
(SURVEY §2.10, §2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docket.functions import arrays as A
from docket.operators import ml, text_vectors
from docket.plans.bindings import with_
from docket.plans.q_metrics import rec_targets
from docket.plans.q_splits import holdout
from docket.plans.registry import query
from docket.session import scratch_path
from docket.sources.files import stored
from docket.sources.tables import table
from docket.streaming import incremental


@query("text_vectors")
def q_text_vectors(spark, d):
    """Vectors of all documents: dimensions, length, and the share of the first dimension."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    v = text_vectors.fit(docs).transform(docs)
    norm = F.sqrt(F.aggregate("features", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return v.select("doc_id", F.size("features").alias("n_dims"), F.round(norm, 4).alias("norm"),
                    F.round(F.abs(F.col("features")[0]), 4).alias("first"))


def labelled_texts(spark, d):
    """Records with a description text (description = document of the case)."""
    r = rec_targets(spark, d).select("case_id", "case_ord", F.col("t").alias("target"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("case_ord"), "text")
    return r.join(docs, "case_ord")


def fitted(spark, d, loss=None):
    """Model and frames with features.  Texts and targets are written once; term statistics, vectors and the
    classifier are fitted on the training texts alone, a tenth of which says when to stop."""
    h = holdout(spark, d).select(F.col("case_id").alias("__h"), F.lit(True).alias("held"))
    data = labelled_texts(spark, d)
    data = stored(data.join(h, data.case_id == h.__h, "left").select("case_id", "target", "text", F.coalesce("held", F.lit(False)).alias("held")),
                  "labelled-texts")
    vectors = text_vectors.fit(data.filter(~F.col("held")))
    data = stored(vectors.transform(data).drop("text"), "text-features")
    train, test = data.filter(~F.col("held")), data.filter("held")
    check = F.pmod(F.xxhash64("case_id"), F.lit(10)) == 0
    model = ml.soft_label_classifier(train.filter(~check), train.filter(check), loss)
    return model, train, test


@query("soft_label_classifier")
def q_soft_label_classifier(spark, d):
    """Training records by target class: how many, and the model's mean probability of each class."""
    model, train, _ = fitted(spark, d)
    s = model.score(train).withColumn("truth", A.argmax(F.col("target")))
    return s.groupBy("truth").agg(F.count(F.lit(1)).alias("n"),
                                  *[F.round(F.avg(F.col("probs")[i]), 6).alias(f"mean_p{i}") for i in range(3)])


@query("batch_score")
def q_batch_score(spark, d):
    model, _, test = fitted(spark, d)
    return model.score(test).select("case_id", *[F.round(F.col("probs")[i], 6).alias(f"p{i}") for i in range(3)], "pred")


@query("evaluate_holdout")
def q_evaluate_holdout(spark, d):
    """KL and macro-F1 on the holdout."""
    model, _, test = fitted(spark, d)
    return ml.evaluate(model.score(test)).withColumnRenamed("loss", "kl").select("kl", "f1_macro", "n")


DOC_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def _split_files(spark, d, src):
    """Documents split into parquet files by doc_id % 5 (the increments)."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    for k in range(5):
        docs.filter(F.col("doc_id") % 5 == k).write.mode("append").parquet(src)
        yield k


@query("incremental_ingest", sql="SELECT doc_id, CAST(length(text) AS INT) AS n_chars FROM documents")
def q_incremental_ingest(spark, d):
    """Increments of which the later ones bring every third earlier item again, changed: each item counts once."""
    base = scratch_path(spark, "ingest")
    src, out, ckpt = f"{base}/in", f"{base}/out", f"{base}/ckpt"
    docs = table(spark, d, "documents").select("doc_id", "text")
    for k in _split_files(spark, d, src):
        if k in (2, 4):   # run after the third and the fifth increment
            incremental.incremental_ingest(spark, src, DOC_SCHEMA, out, ckpt, ["doc_id"])
            again = docs.filter((F.col("doc_id") % 5 <= k) & (F.col("doc_id") % 3 == 0))
            again.select("doc_id", F.concat("text", F.lit(" again")).alias("text")).write.mode("append").parquet(src)
    incremental.incremental_ingest(spark, src, DOC_SCHEMA, out, ckpt, ["doc_id"])
    return incremental.ingested(spark, out, DOC_SCHEMA).select("doc_id", F.length("text").alias("n_chars"))


@query("incremental_upsert", sql=with_("store_old", "store_new") + """
SELECT key, length(text) AS n_chars, md5(text) AS h FROM store_new
UNION ALL
SELECT key, length(text) AS n_chars, md5(text) AS h FROM store_old WHERE key NOT IN (SELECT key FROM store_new)""")
def q_incremental_upsert(spark, d):
    base = scratch_path(spark, "upsert")
    src, store, ckpt = f"{base}/in", f"{base}/store", f"{base}/ckpt"
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("text", T.StringType())])
    docs = table(spark, d, "documents")
    old = docs.filter(F.col("doc_id") % 4 != 0).select(F.col("doc_id").alias("key"), "text", F.lit(1).cast("long").alias("ord"))
    new = docs.filter(F.col("doc_id") % 2 == 0).select(F.col("doc_id").alias("key"),
                                                      F.concat("text", F.lit(" [rev]")).alias("text"), F.lit(2).cast("long").alias("ord"))
    # an earlier state of the same keys in the same increment: the ordinal decides, not the text
    early = new.select("key", F.concat("text", F.lit(" zz")).alias("text"), F.lit(1).cast("long").alias("ord"))
    old.write.mode("append").parquet(src)
    incremental.incremental_upsert(spark, src, schema, store, ckpt, ["key"], ["ord"])
    new.unionByName(early).write.mode("append").parquet(src)
    incremental.incremental_upsert(spark, src, schema, store, ckpt, ["key"], ["ord"])
    final = incremental.latest_store(spark, store, schema)
    return final.select("key", F.length("text").alias("n_chars"), F.md5("text").alias("h"))
