import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from docket.llm.spelling import Filters, _edits, _grouped, _rounds, near_words, variants, vocabulary
import numpy as np


def brute_vocabulary(rows, least, often, every):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= often}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def brute(counts):
    form, n_near = {}, defaultdict(int)
    for w in counts:
        near = [x for x in counts if x != w and is_near(w, x)]
        n_near[w] = len(near)
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], n_near[w], counts.get(form[w])))
    return sorted(out)


def got(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in df.collect())


def texts(seed, size=150):
    rng = random.Random(seed)
    bases = ["".join(rng.choice("abÀàÿ×") for _ in range(rng.randint(3, 7))) for _ in range(25)]
    rows = []
    for i in range(size):
        out = []
        for _ in range(rng.randint(0, 40)):
            w = rng.choice(bases[: rng.randint(1, 25)])
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", "b", "Z", w[k] * 2]) + w[k + 1:]
            out.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i * 37 - 500, rng.choice([" ", "-", "\n", "1"]).join(out)))
    return rows


@pytest.mark.parametrize("least, often, every, most_bytes", [(5, 3, 97, 64 << 20), (1, 1, 5, 64), (2, 2, 3, 4096)])
def test_against_brute_force(spark, least, often, every, most_bytes):
    rows = texts(least)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    words = vocabulary(df, least, often, every)
    want = brute_vocabulary(rows, least, often, every)
    assert {r.word: r.n for r in words.collect()} == want
    assert got(variants(words, most_bytes=most_bytes)) == brute(want)


def test_odd_documents(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    clash = odd_docs.selectExpr("*", "'x' as word", "1 as near", "2 as `a.b`")
    want = brute_vocabulary(rows, 2, 1, 3)
    assert {r.word: r.n for r in vocabulary(clash, 2, 1, 3).collect()} == want
    assert got(variants(vocabulary(clash, 2, 1, 3))) == brute(want)
    assert got(variants(vocabulary(odd_docs.limit(0)))) == []


def test_long_words(spark):
    long = "ab" * 2000
    counts = {long: 3, long[:-1]: 9, long[:999] + "é" + long[1000:]: 40, long + "c": 1, "x" * 63: 2, "x" * 64: 4, "x" * 65: 8, "x" * 66: 16}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert got(variants(df)) == brute(counts)


def test_chains_and_ties(spark):
    counts = {"aaaaa": 1, "aaaab": 2, "aaabb": 4, "aabbb": 8, "abbbb": 16, "bbbbb": 33, "ccccc": 5, "ccccd": 10, "cccca": 10, "zzzzz": 7}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    out = got(variants(df))
    assert out == brute(counts)
    assert {r[0]: r[2] for r in out}["aaaaa"] == "bbbbb" and {r[0]: r[1] for r in out}["ccccc"] == "cccca"


def test_every_near_pair_is_generated_once():
    words = ["abcde", "abcd", "abxde", "abcdde", "bcde", "zbcde", "abcdf", "aabcde"]
    sizes = Counter(len(w) for w in words)
    filters = Filters(dict(sizes))
    for group in _grouped(words):
        filters.add(group)
    found = Counter()
    for group in _grouped(words, 8):
        for i, e in _edits(group, filters, np.arange(97, 123)):
            if e in words:
                found[frozenset((group.words[i], e))] += 1
    assert found == {frozenset((a, b)): 1 for a in words for b in words if a < b and is_near(a, b)}


def test_rounds_hold_their_bytes():
    sizes = {k: 100 * (k + 1) for k in range(5, 20)} | {64: 5}
    for most in (1 << 10, 1 << 15, 1 << 26):
        rounds = list(_rounds(sizes, most))
        assert [x for lengths, _ in rounds for x in lengths] == sorted(sizes)
        for lengths, needed in rounds:
            assert all(x in needed and (x - 1 in needed or x - 1 not in sizes) for x in lengths)
            assert 16 * sum(needed.values()) <= max(most, 64)


def test_a_word_in_every_text(spark):
    rows = [(i, "common " * 50 + f"comon{'x' * (i % 2)} common") for i in range(400)]
    out = {r[0]: r for r in got(variants(vocabulary(spark.createDataFrame(rows, "doc_id long, text string"), every=0)))}
    assert out["common"][3] == 400 * 51 and out["comon"][1] == "common"
    assert near_words(spark.createDataFrame([("abcde", 3)], "word string, n long")).count() == 0
