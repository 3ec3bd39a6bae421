import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docket.llm.fingerprints import Sampler, as_string, edited_likeness, fingerprint, likeness


def generalised_jaccard(a, b):
    keys = a.keys() | b.keys()
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)


@pytest.mark.parametrize("seed", range(4))
def test_collision_rate_is_generalised_jaccard(seed):
    rng = np.random.default_rng(seed)
    draw = Sampler(4096)
    a = {b"w%d" % i: float(w) for i, w in enumerate(rng.integers(1, 9, 60))}
    b = {b"w%d" % i: float(w) for i, w in enumerate(rng.integers(1, 9, 60 + 20 * seed)) if i % 4 or seed > 2}
    want = generalised_jaccard(a, b)
    assert likeness(draw.of_terms(a), draw.of_terms(b)) == pytest.approx(want, abs=4 * (want * (1 - want) / 4096) ** 0.5 + 0.005)


def test_long_texts_are_weighed_in_parts_alike():
    draw = Sampler()
    a = {b"t%d" % i: 1.0 + i % 3 for i in range(7000)}
    b = dict(reversed(a.items()))
    assert (draw.of_terms(a) == draw.of_terms(b)).all()
    half = {k: v for i, (k, v) in enumerate(a.items()) if i % 2}
    assert likeness(draw.of_terms(a), draw.of_terms(half)) == pytest.approx(0.5, abs=0.18)


def brute(rows):
    draw = Sampler()
    rows = sorted(((r.doc_id, r.text or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        h = len(t) // 2
        e = t[: len(t) - h] + nxt[:h]
        p, q = draw.of_text(t), draw.of_text(e)
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), as_string(p), as_string(q), likeness(p, q), likeness(p, draw.of_text(nxt))))
    return sorted(out, key=repr)


def test_edited_and_next(spark, odd_docs):
    got = sorted(map(tuple, edited_likeness(odd_docs).collect()), key=repr)
    assert got == brute(odd_docs.collect())
    many = spark.range(400).select((F.col("id") * F.col("id") * 7 - 5000).alias("doc_id"),
                                   F.concat_ws(" ", F.sequence(F.col("id"), F.col("id") + F.col("id") % 50)).alias("text"))
    assert sorted(map(tuple, edited_likeness(many).collect()), key=repr) == brute(many.collect())
    one = many.limit(1)
    assert sorted(map(tuple, edited_likeness(one).collect()), key=repr) == brute(one.collect())
    assert edited_likeness(odd_docs.limit(0)).count() == 0


def test_equal_texts_have_equal_fingerprints(odd_docs):
    rows = fingerprint(odd_docs).collect()
    by_id = {r.doc_id: r.fingerprint for r in rows}
    assert by_id[5] == by_id[6] == by_id[7] and by_id[0] == by_id[1] == by_id[2] != by_id[3] and len(rows) == odd_docs.count()
