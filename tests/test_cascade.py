"""The cascade of substitutions where the texts lie, and the tables it is made from."""

from pyspark.sql import functions as F

from docket.operators import augment as G
from docket.operators import cascade as C
from docket.sources.files import SHUFFLE_CLEANUP, discard, stored

SYN = [("a", "b"), ("b", "a"), ("c", "d"), ("é", "ö")]
EMB = [("a", "c", 1.0), ("b", "c", 1.0), ("c", "b", 1.0), ("x", "é", 1.0)]
TEXTS = [(1, " A b\tc  x zz "), (2, "Á É x\x0bx c"), (3, ""), (4, None), (5, "zz yy"), (None, "a b c"), (6, "a b c x é " * 40), (7, "c c")]
PLAN = "id int, iteration int, technique string, step int"


def frames(spark):
    docs = spark.createDataFrame(TEXTS, "id int, text string").repartition(3)
    e, s = G.EMBEDDING, G.SYNONYM
    plan = spark.createDataFrame([(i, it, t, k) for i, it, t, k in [
        (1, 0, s, 1), (1, 0, e, 2), (1, 1, e, 1), (2, 0, e, 1), (2, 0, s, 2), (3, 0, s, 1), (4, 0, s, 1), (5, 0, e, 1),
        (6, 0, s, 1), (6, 0, e, 2), (6, 1, e, 1), (6, 1, s, 2), (7, 1, s, 1), (7, 1, s, 2), (None, 0, s, 1)]], PLAN)
    return docs, plan, spark.createDataFrame(SYN, "word string, synonym string"), spark.createDataFrame(EMB, "word string, neighbor string, sim double")


def outputs(df):
    return sorted([(r.id is None, r.id or 0, r.original, r.versions) for r in df.collect()])


def test_versions_are_those_of_the_columns_whatever_is_held(spark, monkeypatch):
    docs, plan, syn, emb = frames(spark)
    # a registered technique that no plan names takes the path of columns
    monkeypatch.setitem(G._REGISTERED, "upper", (F.upper, 0.5))
    names = [*G.TECHNIQUES, "upper"]
    for p_syn, p_emb in ((0.7, 0.5), (1.0, 1.0)):
        want = outputs(G.augment_cascade(docs, "id", "text", plan, syn, emb, 2, p_syn, p_emb, techniques=names))
        for most in (C.HELD_BYTES, 200, 0):
            monkeypatch.setattr(G, "cascaded", lambda *a, m=most: C.cascaded(*a, most=m))
            assert outputs(G.augment_cascade(docs, "id", "text", plan, syn, emb, 2, p_syn, p_emb)) == want
        assert sum(len(r[3]) for r in want) >= 6


def test_cascade_makes_no_row_per_word(spark):
    docs, plan, syn, emb = frames(spark)
    out = G.augment_cascade(docs, "id", "text", plan, syn, emb, 2)
    tree = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in tree and "MapInArrow" in tree


def test_words_most_often_seen_are_held(spark):
    docs, _, syn, emb = frames(spark)
    lexicon = G.paths_lexicon(syn, emb)
    held, others = C.split_lexicon(docs, "text", lexicon, 2 * (C.ENTRY_BYTES + 6))
    every = {r.word for r in held.collect()} | {r.word for r in others.collect()}
    assert every == {"a", "b", "c", "x", "é"} and held.count() < 3
    assert C.split_lexicon(docs, "text", lexicon, C.HELD_BYTES) == (lexicon, None)


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_a_stored_table_leaves_no_shuffle_files(spark):
    spark._jvm.System.gc()
    df = spark.range(1000, numPartitions=4).groupBy((F.col("id") % 7).alias("k")).count()
    before, setting = shuffle_files(spark), spark.conf.get(SHUFFLE_CLEANUP, None)
    out = stored(df, "small")
    assert shuffle_files(spark) <= before and spark.conf.get(SHUFFLE_CLEANUP, None) == setting
    assert sorted(r["count"] for r in out.collect()) == [142] * 1 + [143] * 6
    discard(out)
