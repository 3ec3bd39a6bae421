"""Packing documents into sequences by length patterns.

Documents are tokenised and cut to pieces. The histogram of piece lengths (at most ``size`` bins)
is all that the plan is made from: patterns of one, two or three lengths that fill a sequence are
fitted to it by non-negative least squares, their repeat counts are rounded within what the bins
hold, and what is left over is packed by best fit on the histogram. A pattern repeated k times
takes the next k pieces of each of its lengths. Pieces are numbered within their length by
(length, salt) windows, so a common length is numbered by ``SALTS`` tasks, and look up their
pattern by number. The plan's size depends on the sequence size alone, not on the documents.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docket.llm.common import stored, texts
from docket.llm.pretokens import pretokens

SIZE = 1024
SALTS = 64
#: Steps of the least-squares fit.
STEPS = 1000
#: Fractions of a repeat count from here on are rounded up while the bins last.
UP = 0.1


def patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """Rows (a, b, c) with a >= b >= c, a + b + c = size; b or c is 0 where fewer documents fill it."""
    have = np.zeros(size + 1, bool)
    have[lengths] = True
    rows = [np.array([[size, 0, 0]])] if have[size] else []
    a = lengths[(lengths < size) & (2 * lengths >= size)]
    a = a[have[size - a]]
    rows.append(np.stack([a, size - a, np.zeros_like(a)], 1))
    for c in lengths[3 * lengths <= size]:
        b = np.arange(c, (size - c) // 2 + 1)
        b = b[have[b] & have[size - c - b]]
        rows.append(np.stack([size - c - b, b, np.full_like(b, c)], 1))
    return np.concatenate(rows)


def fit(pattern: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 that bring the lengths used, A x, near ``counts`` in least squares.

    Multiplicative steps x *= A'c / A'Ax keep x non-negative and never raise the squared error.
    """
    size = len(counts) - 1
    used = pattern > 0
    per = [np.where(used[:, k], pattern[:, k], 0) for k in range(3)]

    def back(v: np.ndarray) -> np.ndarray:
        return sum(v[p] * used[:, k] for k, p in enumerate(per))

    goal = counts.astype(float)
    goal[0] = 0
    up = back(goal)
    x = np.full(len(pattern), goal.sum() / max(1, len(pattern)))
    for _ in range(steps):
        fitted = sum(np.bincount(p, x, size + 1) for p in per)
        fitted[0] = 0
        x *= up / np.maximum(back(fitted), 1e-9)
    return x


def rounded(pattern: np.ndarray, x: np.ndarray, counts: np.ndarray) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Whole repeat counts within what the bins hold, and what is left over.

    First the whole parts, largest first; then one more for fractions from ``UP``, largest first.
    """
    left, out, whole = counts.tolist(), [], np.floor(x)
    for order, wanted in ((x, whole), (x - whole, x - whole >= UP)):
        for i in np.argsort(-order, kind="stable").tolist():
            if not wanted[i]:
                continue
            lens = tuple(int(v) for v in pattern[i] if v)
            need = Counter(lens)
            n = min(int(wanted[i]), *(left[v] // k for v, k in need.items()))
            if n > 0:
                out.append((lens, n))
                for v, k in need.items():
                    left[v] -= n * k
    return out, np.array(left)


def best_fit(counts: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: groups of equal sequences take a length together."""
    open_by_room: dict[int, list[list]] = defaultdict(list)
    for length in range(size, 0, -1):
        n = int(counts[length])
        while n:
            room = next((r for r in range(length, size) if open_by_room.get(r)), None)
            if room is None:
                open_by_room[size - length].append([(length,), n])
                break
            lens, k = open_by_room[room].pop()
            take = min(n, k)
            open_by_room[room - length].append([(*lens, length), take])
            if k > take:
                open_by_room[room].append([lens, k - take])
            n -= take
    return [(tuple(lens), n) for groups in open_by_room.values() for lens, n in groups]


def plan(counts: np.ndarray, steps: int = STEPS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, repeat count) for a histogram ``counts[length]``."""
    size = len(counts) - 1
    lengths = np.flatnonzero(counts)
    if not len(lengths):
        return []
    rows = patterns(lengths, size)
    whole, left = rounded(rows, fit(rows, counts, steps), counts) if len(rows) else ([], counts)
    return whole + best_fit(left, size)


class Places:
    """Where the n-th piece of each length goes."""

    def __init__(self, repeated: list[tuple[tuple[int, ...], int]]):
        used, sequence, runs = Counter(), 0, []
        for lens, n in repeated:
            offset = 0
            for v in lens:
                runs.append((v, used[v], sequence, offset))
                used[v] += n
                offset += v
            sequence += n
        runs.sort()
        self.length, self.first, self.sequence, self.offset = np.array(runs, np.int64).reshape(-1, 4).T
        self.key = self.length << 42 | self.first

    def of(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces by length and number within the length."""
        i = np.searchsorted(self.key, length << 42 | number, "right") - 1
        return self.sequence[i] + number - self.first[i], self.offset[i]


def pieces(docs: DataFrame, tokenizer: str, end_id: int | None, size: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document; only the first piece of a longer
    document may be shorter than ``size``."""
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pretokens(tokenizer)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = coder.ids([text])[0] + end
                first = (len(ids) // 4 - 1) % size + 1
                cuts = [0, *range(first, len(ids) // 4 + 1, size)] if ids else [0, 0]
                out += [(doc, k, a, b - a, zlib.crc32(ids[4 * a: 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int | None = 2, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text: the end id alone. Without an end id an empty text is one piece of length 0 with no
    sequence. Null and repeated ids and repeated rows are packed as rows of their own. An empty
    table gives no rows. Sequences are numbered from 0 and filled without gaps.
    """
    cut = stored(pieces(texts(docs, id_col, text_col), tokenizer, end_id, size).withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int")), "pieces")
    # a number per (length, salt): at most size * SALTS rows, whatever the documents
    held = np.zeros((size + 1, SALTS), np.int64)
    for r in cut.groupBy("length", "salt").count().collect():
        held[r.length, r.salt] = r["count"]
    counts = held.sum(1)
    counts[0] = 0
    before = np.cumsum(held, 1) - held
    shared = docs.sparkSession.sparkContext.broadcast((Places(plan(counts)), before))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, before = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length, salt = batch.column("length").to_numpy(), batch.column("salt").to_numpy()
            number = batch.column("number").to_numpy() - 1 + before[length, salt]
            if len(places.key):
                sequence, offset = places.of(length, number)
            else:
                sequence = offset = np.zeros(len(length), np.int64)
            none = length == 0
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                 pa.array(sequence, pa.int64(), mask=none), pa.array(offset, pa.int64(), mask=none)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.withColumn("number", F.row_number().over(
        Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start")).cast("long"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
