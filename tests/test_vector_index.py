"""Indexed searches and ranks against all pairs."""

import numpy as np
import pytest

from docket.operators import vector_index as V

SCHEMA = "id long, v array<double>"


def vectors(seed, n=400, dim=6):
    """Groups of close vectors, a third of all rows in one of them, copies, zero and opposite vectors."""
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(7, dim))
    own = np.where(rng.random(n) < 0.34, 0, rng.integers(0, 7, n))
    x = heads[own] + rng.normal(scale=0.15, size=(n, dim))
    x[::17] = x[0]
    x[3], x[5] = 0, -x[0]
    return x


def rows(x):
    return [(i * 10, v.tolist()) for i, v in enumerate(x)]


def brute_nearest(x, qs, k, itself):
    sims = np.round(x[qs] @ x.T, 9)
    out = []
    for i, q in enumerate(qs):
        order = sorted((-sims[i, j], j) for j in range(len(x)) if itself or j != q)[:k]
        out += [(q * 10, j * 10, -s, r + 1) for r, (s, j) in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("unit, k, itself, round_bytes", [(True, 5, False, 1 << 20), (False, 3, True, 300), (True, 1000, False, 1 << 20)])
def test_nearest(spark, unit, k, itself, round_bytes):
    x = vectors(k)
    if unit:
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    df = spark.createDataFrame(rows(x), SCHEMA).repartition(4)
    index = V.VectorIndex(df, "id", "v", sample=200, cell=32)
    qs = list(range(0, len(x), 9))
    got = V.nearest(df.filter("id % 90 = 0"), df, "id", "v", k, itself, index, round_bytes)
    got = sorted((r.qid, r.cid, r.sim, r.rank) for r in got.collect())
    want = brute_nearest(x, qs, k, itself)
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-9)


@pytest.mark.parametrize("threshold", [0.9, 0.2, -2.0])
def test_at_least(spark, threshold):
    x = vectors(3)
    df = spark.createDataFrame(rows(x), SCHEMA).repartition(3)
    got = V.at_least(df.filter("id % 70 = 0"), df, "id", "v", threshold, V.VectorIndex(df, "id", "v", cell=50))
    sims = np.round(x @ x.T, 9)
    want = sorted((i * 10, j * 10) for i in range(0, len(x), 7) for j in range(len(x)) if i != j and sims[i, j] >= threshold)
    assert sorted((r.qid, r.cid) for r in got.collect()) == want


def test_cells_are_pruned(spark):
    x = vectors(4, 2000, 3)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    df = spark.createDataFrame(rows(x), SCHEMA)
    index = V.VectorIndex(df, "id", "v", cell=64)
    (qids, q), = index.rounds(df.filter("id = 0"), "id", "v")
    kept = V._searched(index, qids, q, np.full(1, 0.99), None, False)
    assert index.cells.count() > 30
    assert 0 < kept.select("cid").distinct().count() < len(x) / 2
    read = [c for c, r in index.reach.items() if V.most_possible(V._angles(q, index.centroids)[:, c], np.ones(1), *r)[0] >= 0.99]
    assert len(read) < len(index.reach) / 2


def test_empty_and_null_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (None, [0.0, 1.0]), (3, [0.5, 0.0])], SCHEMA)
    assert V.nearest(none, none, "id", "v", 3).collect() == []
    assert V.nearest(some, none, "id", "v", 3).collect() == [] and V.nearest(none, some, "id", "v", 3).collect() == []
    got = V.nearest(some.filter("id = 1"), some.filter("id is not null"), "id", "v", 3).collect()
    assert [(r.qid, r.cid, r.sim) for r in got] == [(1, 3, 0.5)]


def test_ranks_and_mrr(spark):
    rng = np.random.default_rng(8)
    s, t = rng.normal(size=(300, 4)), rng.normal(size=(300, 4))
    t[:40] = t[0]  # equal similarities do not lower a rank
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(s, t, strict=True))],
                               "id long, s array<double>, t array<double>").repartition(5)
    sims = np.round(s @ t.T, 9)
    want = {i: 1 + int((sims[i] > sims[i, i]).sum()) for i in range(0, 300, 10)}
    for round_bytes in (1 << 20, 200):
        got = V.own_ranks(df.filter("id % 10 = 0"), df, "id", "s", "t", round_bytes)
        assert {r.id: r.rank for r in got.collect()} == want
    row = V.mrr(df.filter("id % 10 = 0"), df, "id", "s", "t").collect()[0]
    assert (row.mrr, row.n) == (round(float(np.mean([1 / r for r in want.values()])), 6), 30)
    e = [[1.0, 0.0], [0.0, 1.0]]
    two = spark.createDataFrame([(i, e[i], e[1 - i]) for i in range(2)], df.schema)
    assert V.mrr(two, two, "id", "s", "t").collect()[0].mrr == 0.5
    assert V.mrr(two.limit(0), two, "id", "s", "t").collect()[0].n == 0
