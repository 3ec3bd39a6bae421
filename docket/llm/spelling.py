"""Spelling variants: words one edit apart, found by probing Bloom filters with generated edits.

The vocabulary is counted over all texts (every task combines the words it has read). Its words go
into blocked Bloom filters, one for each word length: a word sets a few bits in one 64-bit block of
each of two layers, so a probe touches two places and nearly all absent words end at the first.
Every word's deletions probe the filter of the next shorter length, and its replacements by a later
letter the one of its own length; insertions are the deletions of the longer word, and replacements
by an earlier letter those of the other word. So every pair of near words is generated once. Only
edits that a filter lets through are shuffled, to an exact join with the vocabulary that removes the
false ones.

The filters of one round are at most ``MOST_BYTES``; more words than that are probed in several
rounds of lengths. A single length beyond it gets fewer bits a word: more false edits, same result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docket.llm.common import shuffle_parts, stored, texts

#: Distinct words that a task combines before it passes them on.
COMBINED = 300_000
#: Blocks of 64 bits a word in each of the two layers: 24 bits a word and layer.
BLOCKS_A_WORD = 24 / 64
#: Bytes of the filters that one round sends to every worker.
MOST_BYTES = 64 << 20
#: Words of this length or longer share a filter (their lengths still count in the hash).
LONG = 64
#: Bytes of the filters' slices, edits that are probed at once.
SLICE, PROBED = 1 << 19, 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_RUN = re.compile("[a-zÀ-ÿ]+")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _counted(least: int, every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})

        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                lowered = text.as_buffer().to_pybytes().lower().decode("utf-8", "surrogatepass")
                start = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
                for word, n in Counter(w for w in _RUN.findall(lowered) if len(w) >= least).items():
                    h = zlib.crc32(word.encode(), start)
                    if every and h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < least:
                            continue
                    counts[word] += n
                if len(counts) >= COMBINED:
                    yield rows()
                    counts = Counter()
        yield rows()

    return run


def vocabulary(docs: DataFrame, least: int = 5, often: int = 3, every: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of letters (A-Z, a-z, U+00C0 to U+00FF; A-Z lower-cased) of at least ``least`` letters
    that occur at least ``often`` times.

    Runs are damaged first: with h the crc32 of ``<doc_id>:<run>``, a run whose h is divisible by ``every``
    (0: none) loses its letter h % length. A null id is written as nothing. Null texts have no words.
    """
    counted = texts(docs, id_col, text_col).mapInArrow(_counted(least, every), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= often)


class _Words:
    """Words of one length as a matrix of code points, with the hashes of their prefixes."""

    def __init__(self, words: list[str]):
        self.words, self.length = words, len(words[0])
        self.code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), self.length).astype(np.uint64)
        self.power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(self.length - 1, _BASE, np.uint64))])
        self.term = (self.code + np.uint64(1)) * self.power
        self.upto = np.concatenate([np.zeros((len(words), 1), np.uint64), np.cumsum(self.term, axis=1)], axis=1)
        self.whole = self.upto[:, -1:]

    def __len__(self) -> int:
        return len(self.words)


def _grouped(words: list[str], most: int = 0) -> Iterator[_Words]:
    """Words by length, in matrices of at most about ``most`` letters."""
    by: dict[int, list[str]] = {}
    for w in words:
        by.setdefault(len(w), []).append(w)
    for length, same in by.items():
        step = max(1, most // length) if most else len(same)
        for i in range(0, len(same), step):
            yield _Words(same[i:i + step])


class Filters:
    """Blocked Bloom filters by length: two layers of 64-bit blocks."""

    def __init__(self, sizes: dict[int, int], data: np.ndarray | None = None):
        #: shard -> (first block, blocks of a layer)
        self.places, total = {}, 0
        for shard, blocks in sorted(sizes.items()):
            self.places[shard] = (total, blocks)
            total += 2 * blocks
        self.blocks = np.zeros(total, np.uint64) if data is None else data

    def _spots(self, h: np.ndarray, length: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """(block, bits) of hashes in a layer."""
        first, blocks = self.places[min(length, LONG)]
        h = _mixed(h + np.uint64((length * 2 + layer) * 0xC2B2AE3D27D4EB4F % (1 << 64)))
        at = ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)) + np.uint64(first + layer * blocks)
        six = np.uint64(63)
        one = np.uint64(1)
        bits = one << (h & six) | one << (h >> np.uint64(6) & six) | one << (h >> np.uint64(12) & six) | one << (h >> np.uint64(18) & six)
        return at, bits

    def add(self, words: _Words) -> None:
        for layer in (0, 1):
            at, bits = self._spots(words.whole[:, 0], words.length, layer)
            np.bitwise_or.at(self.blocks, at, bits)

    def passes(self, h: np.ndarray, length: int) -> np.ndarray:
        """Indexes of the hashes that may be words of that length."""
        if min(length, LONG) not in self.places:
            return np.zeros(0, np.int64)
        at, bits = self._spots(h, length, 0)
        kept = np.flatnonzero(self.blocks[at] & bits == bits)
        at, bits = self._spots(h[kept], length, 1)
        return kept[self.blocks[at] & bits == bits]


def _edits(words: _Words, filters: Filters, letters: np.ndarray) -> Iterator[tuple[int, str]]:
    """(index of the word, edited word) of the edits that pass: deletions, replacements by later letters."""
    step = max(1, PROBED // len(words))
    for a in range(0, words.length, step):
        b = min(a + step, words.length)
        code, width = words.code[:, a:b], b - a
        # of equal neighbours only the first is deleted: the others give the same word
        fresh = np.ones(code.shape, bool)
        fresh[:, 1:] = code[:, 1:] != code[:, :-1]
        if a:
            fresh[:, 0] = code[:, 0] != words.code[:, a - 1]
        h = words.upto[:, a:b] + (words.whole - words.upto[:, a + 1:b + 1]) * _BACK
        for k in filters.passes(h.ravel(), words.length - 1).tolist():
            i, p = divmod(k, width)
            if fresh[i, p]:
                w = words.words[i]
                yield i, w[:a + p] + w[a + p + 1:]
        rest = words.whole - words.term[:, a:b]
        for letter in letters.tolist():
            later = np.flatnonzero((code < letter).ravel())
            h = (rest + np.uint64(letter + 1) * words.power[a:b]).ravel()[later]
            for k in later[filters.passes(h, words.length)].tolist():
                i, p = divmod(k, width)
                w = words.words[i]
                yield i, w[:a + p] + chr(letter) + w[a + p + 1:]


def _built(sizes: dict[int, int]):
    """Partial filters of a task in compressed slices, and the letters of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, seen = Filters(sizes), np.zeros(256, bool)
        for batch in batches:
            for words in _grouped(batch.column("word").to_pylist()):
                filters.add(words)
                seen[words.code] = True
        data, letters = filters.blocks.view(np.uint8), np.flatnonzero(seen).tolist()
        if not letters:
            return
        for k in range(0, max(len(data), 1), SLICE):
            part = data[k:k + SLICE]
            if part.any():
                yield pa.RecordBatch.from_pydict({
                    "slice": pa.array([k // SLICE], pa.int32()), "n": pa.array([len(part)], pa.int32()), "letters": pa.array([letters], pa.list_(pa.int32())),
                    "data": pa.array([pa.compress(part.tobytes(), codec="zstd", asbytes=True)], pa.binary())})

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices joined by OR; rows come sorted by slice."""

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"slice": pa.array([now], pa.int32()), "letters": pa.array([sorted(letters)], pa.list_(pa.int32())),
                                           "data": pa.array([data.tobytes()], pa.binary())})

    now, data, letters = None, None, set()
    for batch in batches:
        for r in batch.to_pylist():
            part = np.frombuffer(pa.decompress(r["data"], r["n"], codec="zstd", asbytes=True), np.uint8)
            if r["slice"] != now:
                if now is not None:
                    yield out()
                now, data, letters = r["slice"], part.copy(), set()
            else:
                data |= part
            letters |= set(r["letters"])
    if now is not None:
        yield out()


def _filters(words: DataFrame, sizes: dict[int, int]) -> tuple[Filters, np.ndarray]:
    """The filters of the lengths in ``sizes`` and all their letters; the driver gets at most ``MOST_BYTES``."""
    own = words.filter(F.least(F.length("word"), F.lit(LONG)).isin(list(sizes)))
    parts = own.select("word").mapInArrow(_built(sizes), "slice int, n int, letters array<int>, data binary")
    merged = parts.repartition(shuffle_parts(words.sparkSession), "slice").sortWithinPartitions("slice").mapInArrow(
        _merged, "slice int, letters array<int>, data binary")
    empty = Filters(sizes)
    data, letters = empty.blocks.view(np.uint8), set()
    for r in merged.collect():
        data[r["slice"] * SLICE: r["slice"] * SLICE + len(r["data"])] = np.frombuffer(r["data"], np.uint8)
        letters |= set(r["letters"])
    return empty, np.array(sorted(letters), np.int64)


def _probed(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, letters = known.value
        for batch in batches:
            n_of = dict(zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True))
            for words in _grouped(list(n_of), PROBED):
                own, edited, size = [], [], 0
                for i, edit in _edits(words, filters, letters):
                    own.append(words.words[i])
                    edited.append(edit)
                    size += len(edit)
                    if size > 8 << 20:
                        yield _found(own, edited, n_of)
                        own, edited, size = [], [], 0
                if own:
                    yield _found(own, edited, n_of)

    return run


def _found(own: list[str], edited: list[str], n_of: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"near": pa.array(own, pa.string()), "near_n": pa.array([n_of[w] for w in own], pa.int64()),
                                       "word": pa.array(edited, pa.string())})


def _rounds(sizes: dict[int, int], most_bytes: int) -> Iterator[tuple[list[int], dict[int, int]]]:
    """(lengths whose words probe, blocks of the filters they need) of each round: consecutive lengths, at
    most ``most_bytes`` of filters."""
    most = most_bytes // 16  # blocks of a layer, in all
    cut = {k: min(v, most // 2) or 1 for k, v in sizes.items()}
    now: list[int] = []
    for length in sorted(cut):
        wanted = {k: cut[k] for k in {*now, *(x - 1 for x in [*now, length]), length} if k in cut}
        if now and sum(wanted.values()) > most:
            yield now, {k: cut[k] for k in {*now, *(x - 1 for x in now)} if k in cut}
            now = []
        now.append(length)
    if now:
        yield now, {k: cut[k] for k in {*now, *(x - 1 for x in now)} if k in cut}


def near_words(words: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(word, near, near_n) for both directions of every pair of words (word, n) one edit apart."""
    spark = words.sparkSession
    shard = F.least(F.length("word"), F.lit(LONG))
    counts = {r["shard"]: r["n"] for r in words.groupBy(shard.alias("shard")).agg(F.count("*").alias("n")).collect()}  # at most LONG rows
    sizes = {k: int(v * BLOCKS_A_WORD) + 1 for k, v in counts.items()}
    found = None
    for lengths, needed in _rounds(sizes, most_bytes):
        known = spark.sparkContext.broadcast(_filters(words, needed))
        some = words.filter(shard.isin(lengths)).repartition(shuffle_parts(spark), "word").mapInArrow(
            _probed(known), "near string, near_n long, word string")
        found = some if found is None else found.unionByName(some)
    if found is None:
        return words.select("word", F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = stored(found.join(words, "word").select("word", "n", "near", "near_n"), "near-words")
    return pairs.select("word", "near", "near_n").unionByName(
        pairs.select(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last form reached from (word, form). Each step doubles the part of the chain that
    is followed; a form occurs at least twice as often as its word, so chains are short and end."""
    state = stored(forms.select("word", F.col("form").alias("root")), "word-roots")
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("far"))
        if state.join(ahead, "root", "left_semi").isEmpty():
            return state
        state = stored(state.join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root")), "word-roots")


def variants(words: DataFrame, times: int = 2, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row per word of the vocabulary (word, n): word, form, root, n, n_near, form_n.

    Near words differ by exactly one inserted, deleted or replaced code point. A word's form is its
    near word of largest n (ties: the smallest in code-point order) if that is at least ``times`` its own
    n, else null; the root is the last word reached by following forms, the word itself if it has none.
    Words of any length count. Each word must occur once in ``words``. An empty vocabulary gives no rows.
    """
    words = stored(words.select("word", "n"), "vocabulary")
    near = near_words(words, most_bytes)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    most = -F.col("best.less")
    formed = stored(words.join(best, "word", "left").select(
        "word", F.when(most >= times * F.col("n"), F.col("best.near")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(most >= times * F.col("n"), most).alias("form_n")), "word-forms")
    roots = _roots(formed.filter("form is not null"))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
