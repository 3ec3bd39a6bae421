import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docket.llm.chars import held_out, letters, ngrams
from docket.llm.language_id import ftrl, identify, softmax, temperature
from docket.llm.toxicity import build, isotonic, nearest, terms, toxicity, vector

SF = "/root/testdata/sf0.01"


def test_letters_and_ngrams():
    assert "".join(map(chr, letters("It's 4 ÉTÉ!\n"))) == " it s été "
    assert "".join(map(chr, letters(""))) == " " and "".join(map(chr, letters("😀a"))) == " a "
    assert len(ngrams(letters("abc"), 3, 15)) == 3 and len(ngrams(letters(""), 3, 15)) == 0


def test_held_out_rule(spark):
    rows = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert [r.h for r in rows] == [zlib.crc32(str(r.id).encode()) % 4 == 2 for r in rows]


def test_ftrl_is_sparse_and_separates():
    rng = np.random.default_rng(1)
    rows = []
    for k in range(600):
        y = k % 3
        i = np.unique(np.concatenate([[y * 10 + rng.integers(0, 10)], rng.integers(30, 2000, 5)]))
        rows.append((i, np.full(len(i), len(i) ** -0.5), y))
    w, bias = ftrl(rows, 2000, 3, l1=0.3, epochs=3)
    hits = [int(softmax(v @ w[i] + bias).argmax()) == y for i, v, y in rows]
    assert np.mean(hits) > 0.95 and (w == 0).mean() > 0.5


def test_temperature_finds_the_scale():
    rng = np.random.default_rng(2)
    logits = rng.normal(0, 1.5, (4000, 3))
    y = np.array([rng.choice(3, p=p) for p in softmax(logits)])
    assert temperature(4 * logits, y) == pytest.approx(4, rel=0.1)


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = identify(docs).join(docs, "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and len(out) > 200
    assert np.mean([r.lang_pred == r.lang for r in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    # labels of held-out rows change nothing
    other = docs.withColumn("lang", F.when(held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    again = {r.doc_id: r.lang_pred for r in identify(other).collect()}
    assert again == {r.doc_id: r.lang_pred for r in rows}


def test_languages_of_odd_rows(spark, odd_docs):
    rows = identify(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.doc_id: r for r in rows}
    for i in (0, 1, 2):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert by_id[9].lang_pred in ("en", "de")
    assert identify(odd_docs.limit(0)).count() == 0
    bare = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in identify(bare).collect()} == {"und"}


def test_neighbours_are_exact():
    rng = np.random.default_rng(5)
    column = np.arange(1 << 20, dtype=np.int32)
    rows = []
    for k in range(700):
        cols = np.unique(rng.integers(0, 40, rng.integers(0, 8)))
        vals = rng.random(len(cols)) + 0.1
        rows.append((k, k % 2, cols, vals / max(np.linalg.norm(vals), 1e-12)))
    index = build(column, np.ones(40), rows)
    dense = np.zeros((700, 40))
    for k, (_, _, cols, vals) in enumerate(rows):
        dense[k, cols] = vals
    for k in range(0, 700, 13):
        got = nearest(index, rows[k][2], rows[k][3], 10, but=k)
        scores = dense @ dense[k]
        scores[k] = 0
        want = sorted(((s, i) for i, s in enumerate(scores) if s > 0), key=lambda x: (-round(x[0], 9), x[1]))[:10]
        assert np.allclose([s for s, _ in got], [s for s, _ in want])


def test_isotonic_does_not_fall():
    rng = np.random.default_rng(6)
    votes = rng.random(500)
    at, rates = isotonic(votes, (rng.random(500) < votes).astype(float))
    assert (np.diff(at) > 0).all() and (np.diff(rates) >= 0).all() and 0 <= rates[0] and rates[-1] <= 1


def test_terms_stay_within_words():
    assert len(terms("abcd")) == 2 and len(terms("abc")) == 1 and len(terms("a bb")) == 2 and len(terms("")) <= 1
    assert set(terms("abcd efgh")) == set(terms("abcd")) | set(terms("efgh"))


def test_toxic_words_are_found(spark):
    rng = random.Random(4)
    bad = ["blarghfoo", "snorkwump", "grobnitz"]
    rows, labels = [], []
    for i in range(900):
        w = [f"{rng.choice('abcdefgh')}{rng.choice(['lorem', 'ipsum', 'dolor', 'amet'])}" for _ in range(rng.randint(1, 60))]
        toxic = i % 8 == 0
        if toxic:
            w[rng.randrange(len(w)):0] = rng.sample(bad, 2)
        rows.append((i, " ".join(w)))
        if i % 3:
            labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (5, None), labels[0]], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity(docs, marks).collect()}
    assert len(out) == 900
    assert all(out[i].predicted == int(i % 8 == 0) for i in out)
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in out.values())
    assert out[8].evidence and out[8].evidence[0].toxic == 1 and not out[9].evidence


def test_copies_of_one_toxic_text_do_not_crowd_out_others(spark):
    rng = random.Random(6)
    long = " ".join("".join(rng.choice("bcdfghjklm") for _ in range(8)) for _ in range(1500))
    rows = []
    for i in range(1200):
        w = [f"{rng.choice('abcdefgh')}{rng.choice(['lorem', 'ipsum', 'dolor', 'amet'])}" for _ in range(20)]
        kind = i % 12
        rows.append((i, long if kind in (1, 3) else " ".join([*w, "blarghfoo"] if kind == 2 else w), int(kind in (1, 2, 3))))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = {r.doc_id: r.predicted for r in toxicity(docs.drop("toxic"), docs.select("doc_id", "toxic")).collect()}
    assert [i for i, _, y in rows if out[i] != y and i % 12 not in (1, 3)] == []


def test_toxicity_of_odd_rows(spark, odd_docs):
    marks = spark.createDataFrame([(3, 0), (5, 1)], "doc_id long, toxic int")
    for m in (marks, marks.limit(0), marks.filter("toxic = 1")):
        rows = toxicity(odd_docs, m).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity(odd_docs.limit(0), marks).count() == 0
    none = vector("", np.full(1 << 20, -1, np.int32), np.zeros(0))
    assert len(none[0]) == 0


def small_table(size=80, toxic=5):
    """Rows of which a few hold two words that no other row has."""
    rng = random.Random(9)
    rows = []
    for i in range(size):
        w = [f"{rng.choice('abcdefgh')}{rng.choice(['lorem', 'ipsum', 'dolor', 'amet'])}" for _ in range(12)]
        y = int(i % (size // toxic) == 3)
        rows.append((i, " ".join([*w, "blarghfoo", "snorkwump"] if y else w), y))
    return rows


def test_toxic_words_of_a_small_table(spark):
    rows = small_table()
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = {r.doc_id: r.predicted for r in toxicity(df.drop("toxic"), df.select("doc_id", "toxic")).collect()}
    assert out == {i: y for i, _, y in rows}


def brute_scores(rows):
    """Scores of (id, text, label) rows by dense vectors and plain loops."""
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    learnt = [(i, t, y) for i, t, y in rows if not held(i)]
    distinct = {}
    for _, t, y in learnt:
        distinct[t] = max(y, distinct.get(t, 0))
    total = [sum(1 for y in distinct.values() if y == k) for k in (0, 1)]
    seen = {}
    for t, y in distinct.items():
        for x in set(terms(t).tolist()):
            seen.setdefault(x, [0, 0])[y] += 1
    idf = {}
    for x, (c, t) in seen.items():
        n, p = c + t, t / (c + t)
        low = (p + 1.6**2 / (2 * n) - 1.6 * (p * (1 - p) / n + 1.6**2 / (4 * n * n)) ** 0.5) / (1 + 1.6**2 / n)
        if low * total[0] >= 8 * total[1] * (1 - low):
            idf[x] = np.log((1 + sum(total)) / (1 + n)) + 1

    def vec(text):
        v = {}
        for x in terms(text).tolist():
            if x in idf:
                v[x] = v.get(x, 0) + 1
        v = {x: (1 + np.log(n)) * idf[x] for x, n in v.items()}
        norm = sum(a * a for a in v.values()) ** 0.5
        return {x: a / norm for x, a in v.items()}

    vecs = [(vec(t), y) for _, t, y in learnt]
    prior = (sum(y for _, y in vecs) + 1) / (len(vecs) + 2)

    def vote(v, but=None):
        s = sorted(((sum(a * u.get(x, 0) for x, a in v.items()), -k, y) for k, (u, y) in enumerate(vecs) if k != but), reverse=True)[:25]
        s = [(c * c, y) for c, _, y in s if c > 1e-12]
        return (sum(w * y for w, y in s) + 0.1 * prior) / (sum(w for w, _ in s) + 0.1)

    own = np.array([vote(v, k) for k, (v, _) in enumerate(vecs)])
    at, rates = isotonic(own, np.array([float(y) for _, y in vecs]))
    return {i: float(np.clip(np.interp(vote(vec(t)), at, rates), 0, 1)) for i, t, _ in rows}


def test_toxicity_against_dense_brute_force(spark):
    rng = random.Random(10)
    rows = [(i, t, y if rng.random() > 0.05 else 1 - y) for i, t, y in small_table(300, 40)]  # noisy labels
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = {r.doc_id: r.score for r in toxicity(df.drop("toxic"), df.select("doc_id", "toxic")).collect()}
    want = brute_scores(rows)
    assert max(abs(out[i] - want[i]) for i in want) < 1e-6 and len(set(round(x, 3) for x in want.values())) > 1


def test_rare_label_keeps_its_examples_in_a_small_sample(spark):
    rows = small_table(1200, 12)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = {r.doc_id: r for r in toxicity(df.drop("toxic"), df.select("doc_id", "toxic"), examples=60).collect()}
    assert {i: r.predicted for i, r in out.items()} == {i: y for i, _, y in rows}


def test_dotted_columns(spark, odd_docs):
    marks = spark.createDataFrame([(3, 0), (5, 1)], "doc_id long, toxic int")
    docs = odd_docs.withColumn("a.b", F.lit(1)).withColumn("row", F.lit("x"))
    for found in (identify(docs, whole=True), toxicity(docs, marks, whole=True)):
        back = found.select("row.*")
        assert back.columns == docs.columns and back.count() == docs.count()
    assert identify(docs).count() == toxicity(docs, marks).count() == docs.count()
