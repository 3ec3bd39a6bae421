import random
import re

import numpy as np
import pyarrow as pa
import pytest

from docket.llm import ngram_join
from docket.llm.components import components
from docket.llm.ngram_join import near_duplicates


def shingles(text, n):
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, n, percent):
    sets = [(r.doc_id, shingles(r.text, n)) for r in rows]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, x) in enumerate(sets):
        for j in range(i):
            y = sets[j][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(x), least.get(find(i)) if x else d) for i, (d, x) in enumerate(sets)), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def corpus(spark, seed, size=260):
    """Families of edited copies around the threshold, with a common passage and common lines."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(40)]
    rows = []
    bases = [[rng.choice(words) for _ in range(rng.choice([3, 6, 12, 40, 150]))] for _ in range(12)]
    bases += [passage + [rng.choice(words) for _ in range(rng.randint(1, 60))] for _ in range(30)]
    for i in range(size):
        w = list(rng.choice(bases[:3] if i % 3 else bases))
        for _ in range(rng.randint(0, 1 + len(w) // 40)):
            at = rng.randrange(len(w))
            w[at:at + rng.randint(0, 1)] = [rng.choice([*words, f"new{rng.random()}"])]
        rows.append((rng.randrange(10**6), (" " if i % 2 else "\n").join(w)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 140)] + [(rng.randrange(500, 700), rng.randrange(500, 700)) for _ in range(90)]
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {i: find(i) for a, b in links for i in (a, b) if a != b}
    out = components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.root for r in out.collect()} == want and out.count() == len(want)


@pytest.mark.parametrize("seed,n,percent,small,group", [(1, 4, 85, 16, 256), (2, 5, 80, 3, 4), (3, 4, 85, 2, 0), (4, 1, 50, 2, 256)])
def test_links_match_brute_force(spark, monkeypatch, seed, n, percent, small, group):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "GROUP", group)
    monkeypatch.setattr(ngram_join, "BLOCK", 20)
    docs = corpus(spark, seed).cache()
    assert got(near_duplicates(docs, n, percent)) == brute(docs.collect(), n, percent)


def test_odd_rows(odd_docs):
    assert got(near_duplicates(odd_docs, 4, 85)) == brute(odd_docs.collect(), 4, 85)
    assert near_duplicates(odd_docs.limit(0)).count() == 0


def test_few_common_ngrams_known(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "global_order", lambda rows, words, f=ngram_join.global_order: f(rows, words, 10))
    docs = corpus(spark, 9).cache()
    assert got(near_duplicates(docs, 4, 85)) == brute(docs.collect(), 4, 85)


def test_word_hashes_tell_words_apart():
    text = " Ab  ab aB\tcd " + "x" * 5000 + " " + "x" * 5001 + " é É \x00 a\x00b \x0b y"
    words = text.encode().lower().split()
    h = ngram_join.word_hashes(text)
    assert len(h) == len(words)
    assert len(set(h.tolist())) == len(set(words)) and len(set(zip(h.tolist(), words))) == len(set(words))
    assert len(ngram_join.word_hashes("")) == len(ngram_join.word_hashes(" \n")) == 0


@pytest.mark.parametrize("beside", ["x" * 1100, "漢" * 900, "y" * 5000])
def test_word_hashes_do_not_depend_on_the_text_around(beside):
    words = ["a", "bc", "d" * 1024, "é" * 511]
    alone = ngram_join.word_hashes(" ".join(words[:2])).tolist() + [ngram_join.word_hashes(w)[0] for w in words[2:]]
    for blank in (" ", " " * 1100, "\n" * 3000):
        assert ngram_join.word_hashes(blank + blank.join(words)).tolist() == alone
        assert ngram_join.word_hashes(blank.join([*words, beside])).tolist()[:-1] == alone


def test_near_copies_beside_a_long_word_or_blank_run(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = spark.createDataFrame([(1, text), (2, text + " " + "x" * 1100), (3, "\n" * 2000 + text), (4, text.replace(" w9 ", " " * 1500 + "w9 "))],
                                 "doc_id long, text string")
    assert [r.component_id for r in near_duplicates(rows, 4, 85).collect()] == [1] * 4


@pytest.mark.parametrize("size", range(2, 21))
def test_buckets_do_not_depend_on_batches(monkeypatch, size):
    monkeypatch.setattr(ngram_join, "SMALL", 3)
    rng = random.Random(size)
    rows = []
    for key in range(120):
        rows += [(key, k, 9, c) for c, k in {rng.randrange(10**6): rng.randrange(2) for _ in range(rng.choice([1, 1, 2, 3, 4, 5, 8, size + 1, 2 * size + 1, 30]))}.items()]
    rows = sorted([*rows, *rng.sample(rows, 60)])  # with copies of classes
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[a:a + size], strict=True)], ["key", "k", "n", "class"])
               for a in range(0, len(rows), size)]
    met = [r for b in ngram_join._meet(60)(iter(batches)) for r in b.to_pylist()]
    want_pairs, want_members = set(), set()
    for key in range(120):
        own = sorted({r[1:] for r in rows if r[0] == key})
        large = len(own) > 3
        for i, (k, n, c) in enumerate(own):
            want_members |= {(key, c, k, n)} if large else set()
            for k2, n2, c2 in own[:1] if large and i else [] if large else own[:i]:
                if ngram_join._feasible(*map(np.int64, (k, n, c, k2, n2, c2)), 60):
                    want_pairs.add((min(c, c2), max(c, c2)))
    assert {(r["a"], r["b"]) for r in met if r["key"] is None and r["a"] != r["b"]} == want_pairs
    assert {(r["key"], r["a"], r["k"], r["n"]) for r in met if r["key"] is not None} == want_members


def test_links_in_batches_of_few_rows(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL", 2)
    monkeypatch.setattr(ngram_join, "BLOCK", 20)
    docs = corpus(spark, 5).cache()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert got(near_duplicates(docs, 4, 85)) == brute(docs.collect(), 4, 85)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
