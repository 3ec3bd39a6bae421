"""Removal of repeated passages: windows of words that also start in an earlier document.

Three readings of the texts:

1. every task counts its windows in a count-min sketch; the partial sketches are merged slice by
   slice. A window counts under its anchor, the short word sequence of least hash inside it. Equal
   windows have equal anchors and neighbouring windows mostly share one, so a run of windows is
   one count and the sketch stays small. Anchors and counters only ever count too much, so a window
   with a counter of one occurs once;
2. windows whose counters all reach two are grouped exactly, by 128 bits of their words, and each
   group gives its least document, its owner. Every task combines the windows it has read before
   it passes them on, so a passage in a third of all documents leaves a task once a flush;
3. a document removes the words of its windows estimated repeated that it does not own. A window
   that was only estimated repeated occurs in one document, which owns it. Texts and what they
   own meet by buckets of ids.

No window is lost by the sketch: its size and the data only decide how many single windows are
grouped beside the repeated ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docket.llm.common import shuffle_parts, texts

#: Counter rows of the sketch; bits of a row's length, at least and at most. A merged row is one bit a
#: counter, so what goes to every worker is at most ROWS * 2^MOST_BITS / 8 bytes (128 MB).
ROWS, LEAST_BITS, MOST_BITS = 2, 16, 29
#: Bytes of text for a counter of a row: there is about an anchor in 150 bytes.
BYTES_A_COUNTER = 16
#: Counters of a slice, as a power of two: the piece of a row that one group merges.
SLICE_BITS = 20
#: Windows that a task holds before it passes them on.
HELD = 1 << 21
#: Windows that one group holds, at most about.
GROUPED = 1 << 22
#: Buckets that rows without an id are dealt to.
SALTS = 32
#: A null id stands for the greatest one.
NO_ID = (1 << 63) - 1

#: Bytes of text, and words, that are hashed in one go.
SLICE_BYTES, BYTES, WORDS = 8 << 20, 1 << 18, 1 << 16

_ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _powers(factor: int, n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, factor % (1 << 64), np.uint64))])


def _inverse(factor: int) -> int:
    return pow(factor, -1, 1 << 64)


_BYTE = 0x5851F42D4C957F2D
_UP, _DOWN = _powers(_BYTE, BYTES), _powers(_inverse(_BYTE), BYTES)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[np.uint64(0)], np.cumsum(values)])


def _long_word(b: np.ndarray) -> np.uint64:
    """The polynomial of one word of any length, piece by piece."""
    total = 0
    for i in range(0, len(b), BYTES):
        piece = b[i:i + BYTES]
        total += int(((piece + np.uint64(1)) * _UP[: len(piece)]).sum()) * pow(_BYTE, i, 1 << 64)
    return np.uint64(total % (1 << 64))


def word_hashes(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a 64-bit hash of every word, in order; words of each text) of the texts b[offsets[i]:offsets[i + 1]].

    A word is a run of other bytes than ASCII white space; its hash is a polynomial of its bytes."""
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~_BLANK[b]
    cut = np.zeros(len(b) + 1, bool)
    cut[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        base = starts[i]
        j = int(np.searchsorted(ends, base + BYTES, "right"))
        if j == i:
            j = i + 1
            out[i] = _long_word(b[base:ends[i]])
        else:
            total = _sums((b[base:ends[j - 1]] + np.uint64(1)) * _UP[: ends[j - 1] - base])
            s = starts[i:j] - base
            out[i:j] = (total[ends[i:j] - base] - total[s]) * _DOWN[s]
        i = j
    return _mixed(out), np.diff(np.searchsorted(starts, offsets))


@lru_cache(maxsize=4)
def _steps(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(int(_ODD[which]), WORDS + n), _powers(_inverse(int(_ODD[which])), WORDS + n)


def windows(words: np.ndarray, counts: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """A hash of every ``n`` consecutive words of a text, text after text; ``which`` picks one of two."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    if which:
        words = _mixed(words + _ODD[1])
    up, down = _steps(which, n)
    out = np.empty(len(words) - n + 1, np.uint64)
    for a in range(0, len(out), WORDS):
        part = words[a:a + WORDS + n - 1]
        total = _sums(part * up[: len(part)])
        out[a:a + WORDS] = (total[n:] - total[:-n]) * down[: len(part) - n + 1]
    ends = np.repeat(np.cumsum(counts), counts)[: len(out)]
    return _mixed(out[np.arange(n, n + len(out)) <= ends])


def anchors(words: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """For every window of ``n`` words (as ``windows`` has them) the least hash of the word sequences inside it
    that are a sixth as long."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    short = max(1, n // 6)
    low, width, wide = windows(words, np.array([len(words)]), short), 1, n - short + 1
    while 2 * width <= wide:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < wide:
        low = np.minimum(low[: len(low) - (wide - width)], low[wide - width:])
    ends = np.repeat(np.cumsum(counts), counts)[: len(low)]
    return low[np.arange(n, n + len(low)) <= ends]


class _Slice:
    """Some texts of a batch: ids, words, windows."""

    def __init__(self, ids: pa.Array, b: np.ndarray, offsets: np.ndarray, n: int):
        self.ids = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)
        self.words, self.counts = word_hashes(b, offsets)
        self.n, self.hashes = n, windows(self.words, self.counts, n)
        #: windows of each text
        self.sizes = np.maximum(self.counts - n + 1, 0)
        # neighbouring windows of one text with one anchor are a run
        anchor = anchors(self.words, self.counts, n)
        fresh = np.ones(len(anchor), bool)
        fresh[1:] = anchor[1:] != anchor[:-1]
        starts = np.cumsum(self.sizes) - self.sizes
        fresh[starts[starts < len(fresh)]] = True
        #: the anchor of each run, and each window's run
        self.anchors, self.runs = _mixed(anchor[fresh]), np.cumsum(fresh) - 1

    def suspects(self, sketch: Sketch) -> np.ndarray:
        """Whether each window is estimated repeated."""
        return sketch.repeated(self.anchors)[self.runs] if len(self.runs) else np.zeros(0, bool)


def _slices(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, _Slice]]:
    """Runs of rows of at most about ``SLICE_BYTES`` of text, one row at least."""
    for batch in batches:
        text = batch.column("text")
        wide = pa.types.is_large_string(text.type)
        offsets = np.frombuffer(text.buffers()[1], np.int64 if wide else np.int32)[text.offset:text.offset + len(text) + 1].astype(np.int64)
        data = np.frombuffer(text.buffers()[2], np.uint8) if offsets[-1] > offsets[0] else np.zeros(offsets[-1], np.uint8)
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1)
            yield batch.slice(i, j - i), _Slice(batch.column("doc_id").slice(i, j - i), data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], n)
            i = j


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The counter of each window in a row of the sketch."""
    if row:
        hashes = hashes * _ODD[1]
    return (hashes >> np.uint64(64 - bits)).astype(np.uint32)


def _packed(numbers: np.ndarray) -> bytes:
    """Ascending numbers as compressed gaps, the bytes of equal weight together."""
    gaps = np.diff(numbers, prepend=numbers.dtype.type(0))
    planes = gaps.view(np.uint8).reshape(-1, numbers.itemsize).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, kind) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(-1, n).T).view(kind).ravel(), dtype=kind)


class Sketch:
    """The merged sketch: per row a bit for every counter that reached two."""

    def __init__(self, bits: int, rows: list[bytes]):
        self.bits, self.rows = bits, [np.frombuffer(r, np.uint8) for r in rows]

    def repeated(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each window may occur more than once."""
        out = np.ones(len(hashes), bool)
        for row, bitmap in enumerate(self.rows):
            c = _cells(hashes, row, self.bits)
            out &= (bitmap[c >> np.uint32(3)] >> (c & np.uint32(7)).astype(np.uint8) & 1).astype(bool)
        return out


def _flushed(parts: Iterator[tuple[np.ndarray, ...]], most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The arrays of consecutive parts put together, about ``most`` windows at a time."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= most:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, size = [], 0
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


_PARTIAL = "row int, slice int, n int, counters binary, twice binary"


def _count(n: int, bits: int, most: int):
    """Partial sketches: per row and slice the counters that are not zero, and whether they passed one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (hashes,) in _flushed(((part.anchors,) for _, part in _slices(batches, n)), most):
            out = []
            for row in range(ROWS):
                cells = np.sort(_cells(hashes, row, bits))
                first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
                twice = np.diff(first, append=len(cells)) > 1
                cells = cells[first]
                cuts = np.searchsorted(cells, np.arange(0, (1 << bits) + 1, 1 << min(bits, SLICE_BITS), dtype=np.uint64))
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    if b > a:
                        own = cells[a:b] & np.uint32((1 << SLICE_BITS) - 1)
                        out.append((row, k, int(b - a), _packed(own), pa.compress(np.packbits(twice[a:b]).tobytes(), codec="zstd", asbytes=True)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)],
                ["row", "slice", "n", "counters", "twice"])

    return run


def _merge(bits: int):
    """Merged slices as bitmaps; rows come sorted by (row, slice)."""
    size = 1 << min(bits, SLICE_BITS)

    def bitmap(key, seen: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"row": pa.array([key[0]], pa.int32()), "slice": pa.array([key[1]], pa.int32()),
                                           "bits": pa.array([np.packbits(seen > 1, bitorder="little").tobytes()], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seen = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if key != (r["row"], r["slice"]):
                    if key:
                        yield bitmap(key, seen)
                    key, seen = (r["row"], r["slice"]), np.zeros(size, np.uint8)
                packed = np.frombuffer(pa.decompress(r["twice"], (r["n"] + 7) // 8, codec="zstd", asbytes=True), np.uint8)
                at = _unpacked(r["counters"], r["n"], np.uint32)
                seen[at] = np.minimum(seen[at] + 1 + np.unpackbits(packed, count=r["n"]), 2)
        if key:
            yield bitmap(key, seen)

    return run


def sketch(spark: SparkSession, rows: DataFrame, n: int, bits: int, held: int = HELD) -> Sketch:
    """The count-min sketch of all windows of ``rows`` (doc_id, text), merged over partitions.

    The driver gets the merged bitmaps alone, whose size the parameters bound."""
    parts = rows.mapInArrow(_count(n, bits, held), _PARTIAL)
    merged = parts.repartition(shuffle_parts(spark), "row", "slice").sortWithinPartitions("row", "slice").mapInArrow(
        _merge(bits), "row int, slice int, bits binary")
    size = 1 << min(bits, SLICE_BITS)
    out = [bytearray(1 << bits - 3) for _ in range(ROWS)]
    for r in merged.collect():
        out[r["row"]][r["slice"] * size // 8: (r["slice"] + 1) * size // 8] = r["bits"]
    return Sketch(bits, [bytes(r) for r in out])


_SHARE = "shard int, n int, keys binary, seconds binary, owners binary"


def _candidates(n: int, known, shards: int, most: int):
    """Windows estimated repeated, combined to their least document and dealt by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged = known.value

        def chosen() -> Iterator[tuple[np.ndarray, ...]]:
            for _, part in _slices(batches, n):
                at = part.suspects(merged)
                yield _least(part.hashes[at], windows(part.words, part.counts, n, 1)[at], np.repeat(part.ids, part.sizes)[at])

        for keys, seconds, ids in _flushed(chosen(), most):
            keys, seconds, ids = _least(keys, seconds, ids)
            shard = (keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
            cuts = np.searchsorted(shard, np.arange(shards + 1))
            out = [(k, int(b - a), _packed(keys[a:b]), seconds[a:b].tobytes(), _planes(ids[a:b]))
                   for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)],
                ["shard", "n", "keys", "seconds", "owners"])

    return run


def _planes(numbers: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unplaned(data: bytes, n: int, kind) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(-1, n).T).view(kind).ravel()


def _least(keys: np.ndarray, seconds: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least id of each (key, second), sorted by key."""
    if not len(keys):
        return keys, seconds, ids
    order = np.argsort(keys)
    keys, seconds, ids = keys[order], seconds[order], ids[order]
    same = keys[1:] == keys[:-1]
    if (seconds[1:][same] != seconds[:-1][same]).any():  # one key, two windows
        order = np.lexsort((seconds, keys))
        keys, seconds, ids = keys[order], seconds[order], ids[order]
        same = (keys[1:] == keys[:-1]) & (seconds[1:] == seconds[:-1])
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    return keys[first], seconds[first], np.minimum.reduceat(ids, first)


def _bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    return np.mod(ids ^ (ids >> 15) ^ (ids >> 31), buckets)


_OWNERS = "bucket long, n int, ids binary, keys binary"


def _owned(buckets: int):
    """What each document owns of a shard, packed by bucket of ids; rows come sorted by shard."""

    def owners(parts: list[dict]) -> pa.RecordBatch:
        keys, _, ids = _least(np.concatenate([_unpacked(p["keys"], p["n"], np.uint64) for p in parts]),
                              np.concatenate([np.frombuffer(p["seconds"], np.uint64) for p in parts]),
                              np.concatenate([_unplaned(p["owners"], p["n"], np.int64) for p in parts]))
        bucket = _bucket_of(ids, buckets)
        bucket[ids == NO_ID] = buckets
        order = np.lexsort((keys, bucket))
        keys, ids, bucket = keys[order], ids[order], bucket[order]
        cuts = np.searchsorted(bucket, np.arange(buckets + 2))
        out = []
        for k, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if j > i:
                row = (j - i, _planes(ids[i:j]), _packed(keys[i:j]))
                # every bucket of rows without an id gets what the null id owns
                out += [(to, *row) for to in ([k] if k < buckets else range(buckets, buckets + SALTS))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "n", "ids", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["shard"] != shard:
                    if parts:
                        yield owners(parts)
                    shard, parts = r["shard"], []
                parts.append(r)
        if parts:
            yield owners(parts)

    return run


class _Owned:
    """What the documents of a bucket own."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.ids = None

    def add(self, row: dict) -> None:
        self.parts.append((_unplaned(row["ids"], row["n"], np.int64), _unpacked(row["keys"], row["n"], np.uint64)))

    def of(self, doc_id: int) -> np.ndarray:
        if self.ids is None:
            ids = np.concatenate([x for x, _ in self.parts]) if self.parts else np.zeros(0, np.int64)
            keys = np.concatenate([x for _, x in self.parts]) if self.parts else np.zeros(0, np.uint64)
            order = np.argsort(ids, kind="stable")
            self.ids, self.keys, self.parts = ids[order], keys[order], []
        return self.keys[np.searchsorted(self.ids, doc_id): np.searchsorted(self.ids, doc_id, "right")]


def _rest(batch: pa.RecordBatch, part: _Slice, merged: Sketch, owned: _Owned, n: int) -> pa.RecordBatch:
    """What is left of the texts of a slice."""
    suspect = np.flatnonzero(part.suspects(merged))
    ends = np.cumsum(part.sizes)
    cuts = np.searchsorted(suspect, np.concatenate([[0], ends]))
    out = []
    for i, text in enumerate(batch.column("text")):
        words = text.as_buffer().to_pybytes().split()
        total, removed = len(words), 0
        at = suspect[cuts[i]:cuts[i + 1]]
        if len(at):
            at = at[~np.isin(part.hashes[at], owned.of(part.ids[i]))]
        if len(at):
            at = at - (ends[i] - part.sizes[i])
            edge = np.zeros(total + 1, np.int32)
            edge[at] += 1
            edge[at + n] -= 1
            words = [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
            removed = total - len(words)
        out.append((total, removed, hashlib.sha256(b" ".join(words)).hexdigest()))
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(
        zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _removed(n: int, known):
    """Rows come sorted by bucket, in each first what its documents own and then the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged, bucket, owned = known.value, None, _Owned()
        for batch in batches:
            buckets, is_text = batch.column("bucket").to_numpy(), batch.column("kind").to_numpy() == 1
            edges = np.flatnonzero((buckets[1:] != buckets[:-1]) | (is_text[1:] != is_text[:-1])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                if b > a and buckets[a] != bucket:
                    bucket, owned = buckets[a], _Owned()
                some = batch.slice(a, b - a)
                if b > a and is_text[a]:
                    for rows, part in _slices(iter([some]), n):
                        yield _rest(rows, part, merged, owned, n)
                else:
                    for row in some.select(["n", "ids", "keys"]).to_pylist():
                        owned.add(row)

    return run


def remove_repeats(docs: DataFrame, n: int = 50, id_col: str = "doc_id", text_col: str = "text",
                   most_bits: int = MOST_BITS, grouped: int = GROUPED, held: int = HELD) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed (longs), kept_sha256 (the kept words joined by one space).

    Words are runs of other characters than ASCII white space, unchanged. Each word that lies in a
    window of ``n`` words whose sequence also starts in a row of a smaller id is removed; windows are
    judged on the input. Null text: no words. A null id stands for the greatest id, so its row loses
    against all others. Rows of one id do not remove each other's words. Texts of fewer than ``n``
    words are kept whole. Texts of any length are taken whole. An empty table gives no rows. Extra
    columns are left out.
    """
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text").cast("double"))).head()[0] or 0.0
    bits = int(np.clip(np.ceil(np.log2(max(size / BYTES_A_COUNTER, 1.0))), min(LEAST_BITS, most_bits), most_bits))
    known = spark.sparkContext.broadcast(sketch(spark, rows, n, bits, held))
    # a word and its blank take two bytes or more
    shards = int(max(1, size / 2 / grouped))
    tasks = shuffle_parts(spark)
    buckets = max(tasks, shards)
    shares = rows.mapInArrow(_candidates(n, known, shards, held), _SHARE)
    owned = shares.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(_owned(buckets), _OWNERS)
    bucket = F.when(F.coalesce("doc_id", F.lit(NO_ID)) == NO_ID, F.lit(buckets) + F.pmod(F.xxhash64("text"), F.lit(SALTS))).otherwise(
        F.expr(f"pmod(doc_id ^ shiftright(doc_id, 15) ^ shiftright(doc_id, 31), {buckets})")).cast("long")
    none = F.lit(None)
    both = owned.select("bucket", F.lit(0).alias("kind"), none.cast("long").alias("doc_id"), F.lit("").alias("text"), "n", "ids", "keys").unionByName(
        rows.select(bucket.alias("bucket"), F.lit(1).alias("kind"), "doc_id", "text", none.cast("int").alias("n"),
                    none.cast("binary").alias("ids"), none.cast("binary").alias("keys")))
    return both.repartition(tasks, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(
        _removed(n, known), "doc_id long, n_words long, n_removed long, kept_sha256 string")
