import random
import zlib
from functools import lru_cache

import numpy as np
import pytest

from docket.llm.common import scratch
from docket.llm.pretokens import Pretokens
from docket.llm.token_counts import token_counts
from docket.llm.token_file import id_at, pack, read_tokens, unpack, write_tokens


@lru_cache
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def library_ids(path, text):
    return library(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe", "byte_bpe"])
def test_pretokens_give_the_librarys_ids(name, request):
    path = request.getfixturevalue(name)
    coder = Pretokens(path)
    rng = random.Random(7)
    alphabet = [chr(c) for c in range(0x180)] + list("aaaeeestr     ''''\n\t\x85\xa0") * 6 + ["<|endoftext|>", "漢", "é", "ǅ", "Ⱥ", "İ"]
    for _ in range(1500):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 40)))
        assert np.frombuffer(coder.ids([text])[0], "<u4").tolist() == library_ids(path, text), repr(text)


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_codes_round_trip_and_give_any_id(n):
    rng = np.random.default_rng(n)
    ids = (rng.integers(0, 2**32, n) >> rng.integers(0, 33, n)).astype(np.uint32)
    code = pack(ids)
    assert unpack(code).tolist() == ids.tolist()
    for i in range(0, n, 37):
        assert id_at(code, i) == ids[i]


@pytest.mark.parametrize("segment", [50, 1 << 20])
def test_files_hold_every_document(spark, odd_docs, word_bpe, segment):
    path = scratch(spark, "tokens-test")
    write_tokens(odd_docs, path, word_bpe, segment=segment)
    rows = sorted(read_tokens(spark, path).collect(), key=lambda r: r.start)
    docs = sorted(odd_docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    start = 0
    for r, d in zip(rows, docs, strict=True):
        ids = [*library_ids(word_bpe, d.text), 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_empty_table(spark, odd_docs, word_bpe):
    path = scratch(spark, "tokens-test")
    write_tokens(odd_docs.limit(0), path, word_bpe)
    assert read_tokens(spark, path).count() == 0


@pytest.mark.parametrize("name", ["word_bpe", "byte_bpe"])
def test_parts_encode_one_by_one(name, request):
    path = request.getfixturevalue(name)
    coder = Pretokens(path)
    rng = random.Random(11)
    alphabet = [chr(c) for c in range(0x250)] + list("aaes   '\ń̈가漢😀́İſǅȺΣς​") * 5 + ["<|endoftext|>", "<|startoftext|>"]
    for _ in range(1500):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 30)))
        assert sum(coder.sizes(coder.parts(text))) == len(library_ids(path, text)), repr(text)


@pytest.mark.parametrize("hot", [0, 3, 100_000])
def test_counts(spark, odd_docs, word_bpe, hot):
    rows = token_counts(odd_docs, word_bpe, limit=6, hot=hot).collect()
    want = []
    for d in odd_docs.collect():
        n = len(library_ids(word_bpe, d.text))
        want.append((d.doc_id, len((d.text or "").encode()), n, n > 6))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    assert token_counts(odd_docs.limit(0), word_bpe, hot=hot).count() == 0
