import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docket.llm.common import tokenizer
from docket.llm.sentence_pieces import UNIGRAM, decode, encode, encode_words, pieces

PATH = tokenizer("piece_bpe_32k.model")


def random_texts(n, seed):
    rng = random.Random(seed)
    alphabet = list("etaoinshrdlu" * 3 + "ETAOIN.,'()\"!?0123456789-") + [" "] * 12 + ["\n", "  ", "é", "ü", "漢", "😀", "▁", "the ", "ing", "tion", "http://"]
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("shared", [0, 2000, 96 << 20])
def test_ids_are_the_librarys(spark, odd_docs, shared):
    library = pieces(PATH).library
    docs = spark.createDataFrame(list(enumerate(random_texts(800, 3))), "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text"))
    rows = encode(docs, PATH, shared_bytes=shared).collect()
    want = sorted(((r.doc_id, library.encode(r.text or "")) for r in docs.collect()), key=repr)
    assert sorted(((r.doc_id, r.ids) for r in rows), key=repr) == want
    assert encode(docs.limit(0), PATH, shared_bytes=shared).count() == 0


def test_decoding_gives_the_text(spark, odd_docs):
    texts = [t for t in random_texts(300, 5) if "▁" not in t]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r for r in decode(encode(docs, PATH), PATH).collect()}
    for i, t in enumerate(texts):
        ids = pieces(PATH).library.encode(t)
        assert rows[i].round_trip and rows[i].n_pieces == len(ids), repr(t)
        assert rows[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert rows[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert decode(encode(odd_docs, PATH), PATH).filter("not round_trip").count() == 0
    for shared in (0, 96 << 20):
        assert sorted(map(tuple, encode(odd_docs, PATH, shared_bytes=shared, decoded=True).collect()), key=repr) == sorted(
            map(tuple, decode(encode(odd_docs, PATH), PATH).collect()), key=repr)


def test_viterbi_finds_the_best_path(spark):
    model = pieces(PATH)
    score = {p: s for p, _, s in model.rows}
    ids = {p: i for p, i, _ in model.rows}
    words = sorted({w for t in random_texts(200, 8) for w in model.words(t) if 1 < len(w) < 15 and all(c in score for c in w)})[:150]

    def best(w):
        paths = [(0.0, [])]
        for e in range(1, len(w) + 1):
            paths.append(max((paths[s][0] + score[w[s:e]], paths[s][1] + [ids[w[s:e]]]) for s in range(e) if w[s:e] in score and paths[s] is not None))
        return paths[-1][0]

    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    by_id = {i: s for _, i, s in model.rows}
    text = {i: p for p, i, _ in model.rows}
    for r in encode_words(df, PATH, UNIGRAM).collect():
        assert "".join(text[i] for i in r.ids) == r.word
        assert sum(by_id[i] for i in r.ids) == pytest.approx(best(r.word))


def test_words_join_to_the_text():
    model = pieces(PATH)
    for t in random_texts(200, 9):
        assert "".join(model.words(t)) == ("▁" + t.replace(" ", "▁") if t else "")


def test_word_table_counts_every_word(spark):
    from docket.llm.sentence_pieces import word_counts

    texts = random_texts(100, 4)
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.word: r.n for r in word_counts(docs, PATH).filter(F.length("word") > 0).collect()}
    want = {}
    for t in texts:
        for w in pieces(PATH).words(t):
            want[w] = want.get(w, 0) + 1
    assert got == want


def test_a_task_holds_few_texts_at_a_time(spark):
    """A batch has up to 10 000 rows; all its texts, ids and decoded texts at once took hundreds of MB."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    from docket.llm.sentence_pieces import Words, _with_ids, word_counts

    text = "the words of a text that comes often " * 110
    words = encode_words(word_counts(spark.createDataFrame([(text,)], "text string"), PATH), PATH)
    table = SimpleNamespace(value=Words(words.select("hash", "ids").toArrow()))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(8000), pa.int64()), "text": pa.array([text] * 8000)})
    rows, want = 0, len(pieces(PATH).library.encode(text))
    tracemalloc.start()
    for out in _with_ids(PATH, table, True, False)(iter([batch])):
        rows += out.num_rows
        assert set(out.column("n_pieces").to_pylist()) == {want}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 8000
    assert peak < 40e6, peak


def test_merges_go_by_score_whatever_the_order_of_parts(spark):
    """Made-up pieces whose parts often have lower scores than they, so that a merge makes earlier edges fit."""
    from docket.llm.sentence_pieces import Pieces, merged

    rng = random.Random(11)
    texts = sorted({"".join(rng.choices("abc", k=rng.randint(2, 5))) for _ in range(60)})
    model = object.__new__(Pieces)
    model.rows = [(p, i, float(-rng.randint(0, 40))) for i, p in enumerate(texts)]
    score = {p: s for p, _, s in model.rows}

    def merges(word):
        parts = list(word)
        while True:
            found = [(-score[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in score]
            if not found:
                break
            i = min(found)[1]
            parts[i: i + 2] = [parts[i] + parts[i + 1]]
        return sum(1 << n for n in np.cumsum([0, *map(len, parts)]).tolist())

    words = sorted({"".join(rng.choices("abcd", k=rng.randint(1, 18))) for _ in range(400)} | {"abcab" * 12})
    table = spark.createDataFrame([*model.places(), ("", 0, 0.0, False)], "piece string, place int, score double, late boolean")
    got = {r.word: r.mask for r in merged(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), table, 5).collect()}
    assert got == {w: merges(w) for w in words}


def test_texts_are_cut_alone_and_together():
    model = pieces(PATH)
    texts = ["a b ", " c", "", "", "  ", "▁x", "a" * 200, "\x00\x00a", "é漢😀."]
    alone = [model.words(t) for t in texts]
    cut = model.cut(texts)
    assert cut.words() == [w for ws in alone for w in ws]
    assert cut.text.tolist() == [i for i, ws in enumerate(alone) for _ in ws]
    distinct = set(cut.words())
    assert len(set(zip(cut.hashes(0).tolist(), cut.words()))) == len(distinct) == len(set(cut.hashes(0).tolist())) == len(set(cut.hashes(1).tolist()))
