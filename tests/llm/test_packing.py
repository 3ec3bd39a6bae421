import zlib
from collections import defaultdict

import numpy as np
import pytest
from test_tokens import library_ids

from docket.llm.packing import best_fit, fit, pack, patterns, plan


def test_patterns_fill_a_sequence():
    rows = patterns(np.array([1, 2, 3, 5, 7, 10]), 10)
    want = {(10, 0, 0), (7, 3, 0), (5, 5, 0), (7, 2, 1), (5, 3, 2)}
    assert {tuple(r) for r in rows.tolist()} == want


def test_fit_is_non_negative_and_exact_where_that_is_possible():
    counts = np.zeros(11)
    counts[[10, 7, 3, 5]] = [4, 6, 6, 8]
    rows = patterns(np.flatnonzero(counts), 10)
    x = dict(zip(map(tuple, rows.tolist()), fit(rows, counts, 5000), strict=True))
    assert x[(10, 0, 0)] == pytest.approx(4, abs=0.01) and x[(7, 3, 0)] == pytest.approx(6, abs=0.01)
    assert x[(5, 5, 0)] == pytest.approx(4, abs=0.01)


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_every_piece_and_few_sequences(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(rng.lognormal(5.5, 1, 20_000).astype(int) + 1, 1024)
    counts = np.bincount(lengths, minlength=1025)
    used = np.zeros(1025, int)
    total = 0
    for lens, n in plan(counts):
        assert sum(lens) <= 1024 and n > 0
        total += n
        for v in lens:
            used[v] += n
    assert (used == counts).all()
    least = -(-lengths.sum() // 1024)
    assert total <= least * 1.005 + 2
    assert total <= sum(n for _, n in best_fit(counts.copy(), 1024)) * 1.001 + 1


@pytest.mark.parametrize("size", [7, 1024])
def test_every_id_is_packed_once(spark, odd_docs, byte_bpe, size):
    rows = pack(odd_docs, byte_bpe, size=size).collect()
    docs = defaultdict(list)
    for d in odd_docs.collect():
        docs[d.doc_id].append([*library_ids(byte_bpe, d.text), 2])
    seen = defaultdict(list)
    places = defaultdict(list)
    for r in rows:
        seen[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for d, all_ids in docs.items():
        for ids in all_ids:
            first = (len(ids) - 1) % size + 1
            cuts = [0, *range(first, len(ids) + 1, size)]
            want[d] += [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert {d: sorted(v) for d, v in seen.items()} == {d: sorted(v) for d, v in want.items()}
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
    assert pack(odd_docs.limit(0), byte_bpe).count() == 0


def test_no_end_id(spark, byte_bpe):
    docs = spark.createDataFrame([(1, ""), (2, "a b"), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pack(docs, byte_bpe, end_id=None).collect()}
    assert rows[1].length == 0 and rows[1].sequence_id is None and rows[2].length == 2 and rows[3].offset is None
