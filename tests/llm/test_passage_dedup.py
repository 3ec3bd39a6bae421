import hashlib
import random

import numpy as np
import pytest

from docket.llm.passage_dedup import remove_repeats, windows, word_hashes

BLANK = "\x20\x09\x0a\x0b\x0c\x0d"


def split(text):
    for c in BLANK[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(rows, n):
    docs = [(i, split(t or "")) for i, t in rows]
    rank = lambda i: float("inf") if i is None else i
    first = {}
    for i, w in docs:
        for k in range(len(w) - n + 1):
            s = tuple(w[k:k + n])
            first[s] = min(first.get(s, rank(i)), rank(i))
    out = []
    for i, w in docs:
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k:k + n])] < rank(i):
                gone |= set(range(k, k + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    assert df.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus(seed, size=120):
    rng = random.Random(seed)
    words = ["a", "b", "Ab", "é", "ab", "x" * 300] + [f"w{k}" for k in range(60)]
    passages = [[rng.choice(words[:4]) for _ in range(rng.randint(4, 30))] for _ in range(6)]
    rows = []
    for k in range(size):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += rng.choice(passages)[rng.randint(0, 3):] if rng.random() < 0.5 else [rng.choice(words) for _ in range(rng.randint(1, 9))]
        rows.append((rng.randrange(10**9) - 5 * 10**8, rng.choice([" ", "\n", " \t\r\x0b\x0c"]).join(w)))
        if k % 9 == 0:
            rows.append((rng.randrange(10**9), rows[-1][1]))
    return rows


@pytest.mark.parametrize("n, bits, grouped, held", [(5, 28, 1 << 21, 1 << 21), (5, 4, 4000, 40), (1, 6, 10_000, 1), (12, 10, 10_000, 100)])
def test_against_brute_force(spark, n, bits, grouped, held):
    rows = corpus(n + bits)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(remove_repeats(df, n=n, most_bits=bits, grouped=grouped, held=held)) == brute(rows, n)


def test_odd_documents(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    clash = odd_docs.selectExpr("*", "1 as owned", "2 as key_id", "3 as `a.b`", "4 as shard")
    assert got(remove_repeats(clash, n=3)) == brute(rows, 3)
    assert got(remove_repeats(clash)) == brute(rows, 50)
    assert got(remove_repeats(odd_docs.limit(0))) == []


def hashed(*texts):
    raw = [t.encode() for t in texts]
    return word_hashes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


def test_hashes_follow_words():
    long = "long" * 200_000
    h, counts = hashed("one two  one\ttwo\n" + long + " one two", "", "one", "two ", " ", "x" + long, long)
    assert counts.tolist() == [7, 0, 1, 1, 0, 1, 1]
    assert h[0] == h[2] == h[5] == h[7] and h[1] == h[3] == h[6] == h[8] and h[4] == h[10] and len(set(h.tolist())) == 4
    assert (h[:4] == hashed("  one two one two")[0]).all()
    w = windows(h, counts, 2)
    assert len(w) == 6 and w[0] == w[2] == w[5] and len(set(w.tolist())) == 4
    assert not np.intersect1d(w, windows(h, counts, 2, 1)).size
    many, counts = hashed(*["a b c d e " * 20_000, "e a b c d"] * 2)
    w = windows(many, counts, 3)
    assert len(w) == 2 * (100_000 - 2 + 3) and len(set(w.tolist())) == 5


def test_a_passage_in_every_document(spark):
    passage = [f"p{k}" for k in range(80)]
    rows = [(i, " ".join([f"own{i}"] * (i % 3) + passage + [f"end{i}"])) for i in range(600)]
    out = got(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), held=500))
    assert out == brute(rows, 50)
    assert sum(r[2] for r in out) == 599 * 80
