from collections import Counter

from test_exact_dedup import brute as brute_exact
from pyspark.sql import functions as F
from test_ngram_join import brute as brute_near

import corpus_pipeline as P


def key(r):
    return (r.doc_id is None, r.doc_id or 0, r.text or "")


def test_dedup_stages_match_brute_force(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    once = P.exact_stage(spark, docs, None)
    assert once.columns == docs.columns
    kept = once.collect()
    want = Counter(r[4] for r in brute_exact(docs.collect()))
    assert len(kept) == len(want)
    assert sorted((r.doc_id for r in kept), key=lambda d: (d is None, d)) == sorted(
        {r[1]: 0 for r in brute_exact(docs.collect())}, key=lambda d: (d is None, d))
    near = P.near_stage(spark, once, None).collect()
    groups = {(c if n else ("own", d)) for d, n, c in brute_near(kept, 5, 80)}
    assert len(near) == len(groups)
    # without the exact stage before it, repeated rows still leave one row
    alone = P.near_stage(spark, docs, None).collect()
    assert len({key(r) for r in alone}) == len(alone)


def test_run(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = docs
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, left, sf).cache()
        assert out.columns == docs.columns and 0 < out.count() <= left.count(), name
        left = out
    pieces = P.run(spark, sf)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in left.select("doc_id").collect()}


def test_empty_table(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, "/root/testdata/sf0.001").count() == 0


def test_stages_keep_dotted_columns_and_odd_rows(spark, odd_docs):
    docs = odd_docs.withColumn("a.b", F.lit(1))
    for stage in (P.exact_stage, P.near_stage):
        out = stage(spark, docs, None)
        assert out.columns == docs.columns and out.count() > 0
    sf = "/root/testdata/sf0.001"
    left = docs
    for _, stage in P.STAGES[:-1]:
        left = stage(spark, left, sf).cache()
        assert left.columns == docs.columns
    P.packing_stage(spark, left, sf).count()
