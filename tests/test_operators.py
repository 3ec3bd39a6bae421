"""Operator edge cases and invariants on literal rows."""

import math
import random
import statistics

from pyspark.sql import functions as F

from docket.operators import metrics, setops, splits, text, vectors


def test_f1_macro_edges(spark):
    # class 2 absent on both sides → 1.0; class 1 only predicted → 0.0
    df = spark.createDataFrame([(0, 0), (0, 1), (0, 0)], "t int, p int")
    r = metrics.f1_macro(df, "t", "p", 3).collect()[0]
    assert r.f1_2 == 1.0 and r.f1_1 == 0.0
    assert math.isclose(r.f1_0, round(2 * 2 / (3 + 2), 6))


def test_medians_by_refined_histograms(spark):
    rng = random.Random(3)
    groups = {"one": [0.5], "same": [0.25] * 40, "even": [rng.random() for _ in range(200)], "odd": [rng.gauss(0, 1) for _ in range(301)],
              "ties": [rng.choice([1.0, 2.0, 2.0, 3.0]) for _ in range(150)], None: [1e-300, 1e300, -1e300, 5.0], "gap": [0.0] * 50 + [1.0] * 50}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    rng.shuffle(rows)
    df = spark.createDataFrame([*rows, ("none", None)], "g string, v double").repartition(4)
    want = {g: statistics.median(vs) for g, vs in groups.items()}
    for bins, held in ((4, 3), (1024, 4096), (7, 20)):
        assert {r.g: r["median"] for r in vectors.medians(df, "g", "v", bins, held).collect()} == want


def test_cluster_cohesion_golden(spark):
    # two unit vectors with cos 0.5 → distance to centroid 1 - sqrt(0.75) = 0.133975
    a = [1.0, 0.0]
    b = [0.5, math.sqrt(3) / 2]
    df = spark.createDataFrame([("B", a), ("B", b), ("O", a)], "c string, v array<double>")
    got = {r.c: r for r in vectors.cluster_cohesion(df, "c", "v", 2).collect()}
    assert math.isclose(got["B"].mean_cos_dist, 0.133975, abs_tol=1e-6)
    assert got["O"].size == 1 and abs(got["O"].mean_cos_dist) < 1e-9


def test_median_interpolates(spark):
    df = spark.createDataFrame([("A", [1.0, 0.0]), ("A", [0.0, 1.0]), ("A", [1.0, 1.0]), ("A", [1.0, 0.2])],
                               "c string, v array<double>")
    r = vectors.cluster_cohesion(df, "c", "v", 2).collect()[0]
    assert r.size == 4 and r.median_cos_dist <= r.max_cos_dist


def test_global_rank_partition_independent(spark):
    df = spark.range(0, 500).select((F.col("id") % 7).alias("y"), F.col("id").alias("o"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        out = []
        for n in ("1", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            r = splits.global_rank(df, [F.col("y").desc(), F.col("o").asc()])
            out.append(sorted((x.o, x.rn) for x in r.collect()))
        assert out[0] == out[1]
        expect = sorted(df.collect(), key=lambda x: (-x.y, x.o))
        assert [o for o, _ in sorted(out[0], key=lambda t: t[1])] == [x.o for x in expect]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_holdout_floor_and_ties(spark):
    df = spark.createDataFrame([(i, 2000 + (i % 3)) for i in range(10)], "ord long, year int")
    h = splits.holdout_most_recent(df, "year", "ord", 0.25).collect()  # floor(2.5) = 2
    assert sorted(r.ord for r in h) == [2, 5]


def test_train_val_drops_same_year(spark):
    ds = spark.createDataFrame([(f"c{i}", i, 2000 + i // 3) for i in range(9)], "case_id string, ord long, year int")
    hold = ds.filter("ord = 8")
    tv = splits.split_time_train_val(ds, hold, "case_id", "year", "ord").collect()
    assert all(r.year < 2002 for r in tv) and len(tv) == 6


def test_cv_forward_folds(spark):
    df = spark.createDataFrame([(i, 2000) for i in range(11)], "ord long, year int")
    f = splits.cv_forward_folds(df, "year", "ord", 3, 2, 3).collect()
    assert sorted({r.fold for r in f}) == [0, 1]  # 11 rows: two full folds of 5, the third short → skipped


def test_cv_backward_folds_clip(spark):
    df = spark.createDataFrame([(i, 1990 + i) for i in range(12)], "ord long, year int")
    f = splits.cv_backward_folds(df, "year", "ord", test_size=2, train_size=6, val_size=2, n_folds=5,
                                 fallback_val=2).collect()
    folds = {}
    for r in f:
        folds.setdefault(r.fold, {"train": [], "val": []})[r.role].append(r.ord)
    assert sorted(folds[0]["val"]) == [8, 9] and sorted(folds[0]["train"]) == [2, 3, 4, 5, 6, 7]
    assert sorted(folds[3]["train"]) == [0, 1]  # clipped at 0
    assert 4 not in folds  # empty train → stop


def test_upsert_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "key int, text string")
    new = spark.createDataFrame([(2, "B"), (3, "C"), (None, "N")], "key int, text string")
    once = setops.upsert_new_wins(old, new, ["key"]).drop("src")
    twice = setops.upsert_new_wins(once, new, ["key"]).drop("src")
    assert sorted(once.collect(), key=str) == sorted(twice.collect(), key=str) == [(1, "a"), (2, "B"), (3, "C"), (None, "N")]


def test_early_stop_strict(spark):
    vals = [5.0, 4.0, 4.0, 4.0, 3.0, 3.5]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(vals)], "run int, epoch int, value double")
    r = metrics.early_stop(df, ["run"], "epoch", "value", patience=2).collect()[0]
    assert (r.stop_epoch, r.best_epoch, r.best_value, r.stopped) == (3, 1, 4.0, True)


def test_parse_doc_header(spark):
    rows = [(1, "k1", "Case ID: A\nCitation: 1 U.S. 2\n=====\n\nbody one\n"),
            (2, "k2", "Case ID: B\nno rule here"),
            (3, "k3", "Citation: x\n=====\nCase ID: C\nbody"),
            (4, "k4", "Case ID: A\n=====\nlater body")]
    df = spark.createDataFrame(rows, "file_ord long, file_key string, text string")
    got = {r.case_id: r.body for r in text.parse_doc_header(df).collect()}
    assert got == {"A": "later body"}


def test_pad_and_mask(spark):
    from docket.operators.tokens import pad_and_mask
    df = spark.createDataFrame([(0, [2, 3]), (0, [2, 9, 9, 3]), (1, [])], "b int, input_ids array<int>")
    r = {tuple(x.input_ids): (x.padded_ids, x.padded_mask) for x in pad_and_mask(df, "b").collect()}
    assert r[(2, 3)] == ([2, 3, 0, 0], [1, 1, 0, 0])
    assert r[()] == ([], [])


def test_early_stop_chunked_scan_matches(spark):
    import random
    rnd = random.Random(7)
    rows = [(run, e, float(rnd.randint(0, 20))) for run in range(4) for e in range(rnd.randint(5, 40))]
    df = spark.createDataFrame(rows, "run int, epoch int, value double")
    for kw in ({"patience": 3}, {"patience": 2, "only_even": True, "min_epochs": 4}):
        big = sorted(metrics.early_stop(df, ["run"], "epoch", "value", chunk_rows=1 << 20, **kw).collect())
        small = sorted(metrics.early_stop(df, ["run"], "epoch", "value", chunk_rows=3, **kw).collect())
        assert big == small
