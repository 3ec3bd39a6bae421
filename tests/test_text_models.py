"""Text vectors against a full decomposition, the classifier against plain gradient descent."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docket.operators import ml, text_vectors as T


def corpus(seed, n=160):
    """Texts of topics whose words differ."""
    rng = np.random.default_rng(seed)
    topics = [[f"t{k}w{i}" for i in range(30)] for k in range(4)]
    shared = [f"s{i}" for i in range(40)]
    rows = []
    for i in range(n):
        words = list(rng.choice(topics[i % 4], 12)) + list(rng.choice(shared, 10))
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
    return rows


def plain_matrix(spark, rows, terms):
    """The dense matrix of the texts' rows, from counts."""
    df = spark.createDataFrame(rows, "id long, text string")
    bags = {r.id: r.bag for r in T.bags(df, "text", terms).collect()}
    c = np.zeros((len(rows), terms))
    for i, _ in rows:
        for t in bags[i]:
            c[i, t] += 1
    with np.errstate(divide="ignore", invalid="ignore"):
        v = np.log(c * c.sum() / (c.sum(1, keepdims=True) * c.sum(0)))
    v = np.where(np.isfinite(v) & (v > 0), v, 0.0)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


@pytest.mark.parametrize("parts", [1, 40])
def test_reconstruction_is_near_the_best(spark, parts):
    rows, terms, dim = corpus(1), 512, 20
    df = spark.createDataFrame(rows, "id long, text string").repartition(parts)
    model = T.fit(df, "text", dim, terms, oversample=10)
    m = plain_matrix(spark, rows, terms)
    u, s, vt = np.linalg.svd(m, full_matrices=False)
    best = np.linalg.norm(m - (u[:, :dim] * s[:dim]) @ vt[:dim])
    assert model.right.shape == (terms, dim) and np.allclose(model.right.T @ model.right, np.eye(dim), atol=1e-8)
    assert np.linalg.norm(m - m @ model.right @ model.right.T) <= 1.03 * best
    assert np.allclose(model.values[:4], s[:4], rtol=0.02)
    got = {r.id: np.array(r.features) for r in model.transform(df, unit=False).collect()}
    assert all(np.allclose(got[i], m[i] @ model.right, atol=1e-5) for i, _ in rows)


def test_exact_when_the_rank_is_small(spark):
    rows = corpus(2, 12)
    df = spark.createDataFrame(rows, "id long, text string")
    model = T.fit(df, "text", 384, 1024)
    m = plain_matrix(spark, rows, 1024)
    assert len(model.values) == np.linalg.matrix_rank(m)
    assert np.allclose(m @ model.right @ model.right.T, m, atol=1e-6)
    vectors = model.transform(df).collect()
    assert all(len(r.features) == 384 and abs(np.linalg.norm(r.features) - 1) < 1e-5 for r in vectors)


def test_neighbours_are_better_than_hashing(spark):
    rows = corpus(3, 240)
    df = spark.createDataFrame(rows, "id long, text string")
    dim = 8

    def same_topic(x):
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        sims = x @ x.T
        np.fill_diagonal(sims, -9)
        return np.mean([[j % 4 == i % 4 for j in np.argsort(-sims[i])[:5]] for i in range(len(x))])

    learnt = {r.id: r.features for r in T.fit(df, "text", dim, 2048).transform(df).collect()}
    hashed = plain_matrix(spark, rows, dim)
    assert same_topic(np.array([learnt[i] for i, _ in rows])) > max(0.95, same_topic(hashed) + 0.2)


def test_texts_without_words(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (4, "one")], "id long, text string")
    model = T.fit(df, "text", 4, 64)
    got = {r.id: r.features for r in model.transform(df).collect()}
    assert got[1] == got[2] == [0.0] * 4 and any(got[3])
    none = T.fit(df.limit(0), "text", 4, 64).transform(df.withColumnRenamed("id", "a.b"))
    assert none.columns == ["a.b", "text", "features"] and all(r.features == [0.0] * 4 for r in none.collect())


def problem(seed, n=300, dim=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    z = x @ rng.normal(size=(dim, 3)) + rng.normal(scale=0.3, size=(n, 3))
    t = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    return x, t


def plain_fit(x, t, loss, reg, steps=4000, rate=0.5):
    w, b = np.zeros((3, x.shape[1])), np.zeros(3)
    for _ in range(steps):
        _, g = ml._LOSSES[loss](x @ w.T + b, t)
        w -= rate * (g.T @ x / len(x) + reg * w)
        b -= rate * g.mean(0)
    return w, b, ml._LOSSES[loss](x @ w.T + b, t)[0].mean() + 0.5 * reg * (w * w).sum()


@pytest.mark.parametrize("loss", ["KL", "mse"])
def test_classifier_against_plain_descent(spark, loss):
    x, t = problem(4)
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, t, strict=True)], "features array<double>, target array<double>")
    model = ml.soft_label_classifier(df.repartition(40), loss=loss, max_iter=60, reg=1e-3, patience=60, tolerance=1e-7)
    w, b, value = plain_fit(x, t, loss.upper(), 1e-3)
    assert model.loss == loss.upper()
    assert model.history[-1][0] <= value + 1e-5
    p = ml._softmax(x @ model.weights.T + model.bias)
    assert np.allclose(p, ml._softmax(x @ w.T + b), atol=0.01)
    scored = model.score(df).collect()
    assert all(abs(sum(r.probs) - 1) < 1e-9 and r.pred == int(np.argmax(r.probs)) for r in scored)


@pytest.mark.parametrize("loss", ["KL", "MSE"])
def test_gradients(loss):
    x, t = problem(5, 6)
    z = x @ np.ones((4, 3)) + np.arange(3.0)
    value, grad = ml._LOSSES[loss](z, t)
    for i in range(6):
        for k in range(3):
            e = np.zeros_like(z)
            e[i, k] = 1e-6
            numeric = (ml._LOSSES[loss](z + e, t)[0][i] - ml._LOSSES[loss](z - e, t)[0][i]) / 2e-6
            assert abs(numeric - grad[i, k]) < 1e-6


def test_validation_stops_the_training(spark):
    rng = np.random.default_rng(6)
    rows = [(rng.normal(size=40).tolist(), np.eye(3)[rng.integers(3)].tolist()) for _ in range(60)]  # nothing to learn
    df = spark.createDataFrame(rows, "features array<double>, target array<double>")
    model = ml.soft_label_classifier(df.limit(40), df.subtract(df.limit(40)), reg=0.0, max_iter=50, patience=2)
    held = [h for _, h in model.history]
    assert len(held) < 20 and min(held) == min(held[: len(held) - 2])
    p = ml._softmax(np.array([r[0] for r in rows]) @ model.weights.T + model.bias)
    assert p.max() < 0.99


def test_losses_by_name(spark):
    assert ml.loss_name() == ml.loss_name("kl") == "KL" and ml.loss_name("Mse") == "MSE"
    with pytest.raises(ValueError, match=r"Known losses: \['KL', 'MSE'\]"):
        ml.loss_name("hinge")
    df = spark.createDataFrame([([0.7, 0.2, 0.1], [1.0, 0.0, 0.0], 0), ([0.1, 0.8, 0.1], [0.5, 0.5, 0.0], 1)],
                               "probs array<double>, target array<double>, pred int")
    kl = ml.evaluate(df).collect()[0]
    assert kl.loss == round((-np.log(0.7) + 0.5 * np.log(0.5 / 0.1) + 0.5 * np.log(0.5 / 0.8)) / 2, 6)
    assert ml.evaluate(df, loss="mse").collect()[0].loss == round((0.14 + 0.16 + 0.09 + 0.01) / 6, 6)
    # class 2 is absent on both sides, class 1 is only predicted, class 0 is half found
    assert kl.f1_macro == round((2 / 3 + 0 + 1) / 3, 6) and kl.n == 2


def test_unclear_and_missing_targets(spark):
    df = spark.createDataFrame([([1.0], [-1.0, -1.0, -1.0]), ([2.0], None), (None, [1.0, 0.0, 0.0])], "features array<double>, target array<double>")
    model = ml.soft_label_classifier(df)
    assert np.allclose(ml._softmax(model.bias[None]), 1 / 3)
    empty = ml.soft_label_classifier(df.filter(F.lit(False)))
    assert empty.weights.shape == (3, 0)


def test_a_block_of_texts_is_added_up_by_term():
    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.choice(40, n, replace=False)), rng.random(n)) for n in (5, 1, 40, 12)]
    y, got, want = rng.random((4, 7)), np.zeros((40, 7)), np.zeros((40, 7))
    T._add_by_term(got, rows, y)
    for (at, v), q in zip(rows, y):
        want[at] += np.outer(v, q)
    assert np.allclose(got, want, atol=1e-12)


def test_training_rows_are_stored_as_matrices(spark, monkeypatch):
    kept = {}
    stored = ml.stored
    monkeypatch.setattr(ml, "stored", lambda df, name: kept.setdefault(name, stored(df, name)))
    rows = spark.createDataFrame([([float(i % 2), 1.0], [1.0, 0.0, 0.0] if i % 2 else [0.0, 1.0, 0.0]) for i in range(50)],
                                 "features array<float>, target array<double>").coalesce(1)
    model = ml.soft_label_classifier(rows, max_iter=3)
    assert kept["training-rows"].count() == 1 and model.weights.shape == (3, 2)
