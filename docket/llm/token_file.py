"""Token-id files of directly addressable codes.

An id is cut into chunks of 8 bits. Level 0 holds the lowest chunk of every id, level k the k-th
chunk of the ids that reach it. Beside its chunks a level has a continuation bitmap (bit i: chunk i
goes on in the next level) and a rank directory (set bits before every ``RANK_STEP``-th bit). The
place of id i in the next level is the rank of bit i, so any single id is read from one chunk per
level, without decoding a block.

The files are Parquet written by Spark, one row per segment: a run of whole documents in ascending
id order, about ``SEGMENT`` ids, more only where one document is longer. Columns: ``part`` and
``segment`` (order of the segments), ``before`` (ids of the part before this segment), ``n_tokens``, ``doc_ids`` and ``doc_starts`` (little-endian
64-bit integers, places within the segment), ``no_id`` (bitmap of documents whose id is null) and
``code`` (the levels). Files can be read wherever Spark can read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docket.llm.common import shuffle_parts, texts
from docket.llm.pretokens import pretokens

SEGMENT = 1 << 20
#: Bits of a bitmap between two entries of its rank directory.
RANK_STEP = 512
MAGIC = b"DAC1"


def pack(ids: np.ndarray) -> bytes:
    """The levels of unsigned 32-bit ids as bytes."""
    rest, out = ids.astype(np.uint32, copy=False), []
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        pad = np.zeros(-len(bits) % (RANK_STEP // 8), np.uint8)
        per_step = np.bitwise_count(np.concatenate([bits, pad])).reshape(-1, RANK_STEP // 8).sum(1, dtype=np.uint32)
        ranks = np.concatenate([[0], np.cumsum(per_step, dtype=np.uint32)]).astype("<u4")
        out.append(struct.pack("<Q", len(rest)) + rest.astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes())
        rest = rest[more] >> 8
        if not len(rest):
            return MAGIC + struct.pack("<I", len(out)) + b"".join(out)


def levels(code: bytes) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap, rank directory) of each level, as views of ``code``."""
    if code[:4] != MAGIC:
        raise ValueError("not a code of this format")
    at, out = 8, []
    for _ in range(struct.unpack_from("<I", code, 4)[0]):
        (n,) = struct.unpack_from("<Q", code, at)
        m = -(-n // 8)
        steps = -(-m // (RANK_STEP // 8)) + 1
        out.append((np.frombuffer(code, np.uint8, n, at + 8), np.frombuffer(code, np.uint8, m, at + 8 + n),
                    np.frombuffer(code, "<u4", steps, at + 8 + n + m)))
        at += 8 + n + m + 4 * steps
    return out


def id_at(code: bytes, i: int) -> int:
    """Id number ``i`` alone: one chunk per level, found by rank."""
    value = 0
    for k, (chunks, bits, ranks) in enumerate(levels(code)):
        value |= int(chunks[i]) << (8 * k)
        if not bits[i >> 3] >> (i & 7) & 1:
            break
        step = i // RANK_STEP
        before = bits[step * RANK_STEP // 8: i >> 3]
        i = int(ranks[step]) + int(np.bitwise_count(before).sum()) + int(np.bitwise_count(bits[i >> 3] & ((1 << (i & 7)) - 1)))
    return value


def unpack(code: bytes) -> np.ndarray:
    """All ids."""
    parts = levels(code)
    rest = np.zeros(0, np.uint32)
    for chunks, bits, _ in reversed(parts):
        ids = chunks.astype(np.uint32)
        ids[np.unpackbits(bits, count=len(chunks), bitorder="little").view(bool)] |= rest << 8
        rest = ids
    return rest


def _segments(path: str, end_id: int | None, segment: int):
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def rows(part: int, number: int, before: int, docs: list, ids: list[bytes]) -> pa.RecordBatch:
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        code = pack(np.frombuffer(b"".join(ids), "<u4"))
        return pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "segment": pa.array([number], pa.int64()),
            "before": pa.array([before], pa.int64()),
            "n_tokens": pa.array([int(sizes.sum())], pa.int64()),
            "doc_ids": pa.array([np.array([d or 0 for d in docs], "<i8").tobytes()], pa.binary()),
            "doc_starts": pa.array([(np.cumsum(sizes) - sizes).astype("<i8").tobytes()], pa.binary()),
            "no_id": pa.array([np.packbits([d is None for d in docs], bitorder="little").tobytes()], pa.binary()),
            "code": pa.array([code], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, number, before = pretokens(path), TaskContext.get().partitionId(), 0, 0
        docs: list = []
        ids: list[bytes] = []
        size = 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                docs.append(doc)
                ids.append(coder.ids([text])[0] + end)
                size += len(ids[-1]) // 4
                if size >= segment:
                    yield rows(part, number, before, docs, ids)
                    number, before, docs, ids, size = number + 1, before + size, [], [], 0
        if docs:
            yield rows(part, number, before, docs, ids)

    return run


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id",
                 text_col: str = "text", segment: int = SEGMENT) -> None:
    """Write the ids of every text, in ascending document id, as a folder of token files.

    Null text: no ids but the end id. Null document ids come first. Repeated ids and texts are
    written as often as they come. An empty table gives an empty folder of files.
    """
    rows = texts(docs, id_col, text_col)
    placed = rows.repartitionByRange(shuffle_parts(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    placed.mapInArrow(
        _segments(tokenizer, end_id, segment),
        "part int, segment long, before long, n_tokens long, doc_ids binary, doc_starts binary, no_id binary, code binary",
    ).write.parquet(out)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            ids = unpack(r["code"]).astype("<u4", copy=False)
            names, starts = np.frombuffer(r["doc_ids"], "<i8"), np.frombuffer(r["doc_starts"], "<i8")
            ends = np.append(starts[1:], len(ids))
            none = np.unpackbits(np.frombuffer(r["no_id"], np.uint8), count=len(names), bitorder="little").view(bool)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(names, pa.int64(), mask=none),
                "start": pa.array(starts + r["part_start"] + r["before"], pa.int64()),
                "n_tokens": pa.array(ends - starts, pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)], pa.int64())})


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a folder of token files: doc_id, start (ids of all documents before it),
    n_tokens and ids_crc32, from the ids as decoded."""
    segments = spark.read.parquet(path)
    # one row per written part, at most as many as the write had shuffle partitions
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    starts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    return segments.join(F.broadcast(starts), "part").mapInArrow(
        _documents, "doc_id long, start long, n_tokens long, ids_crc32 long")
