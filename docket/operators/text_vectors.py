"""Dense text vectors: randomised singular value decomposition of a text-term matrix.

The original embeds texts with a pretrained encoder of 384 dimensions; here the vectors are learnt from the
corpus.  A text's row holds the positive pointwise mutual information of the text and each of its terms, scaled
to length one; terms are words, hashed to ``terms`` columns, so every word counts and the model's size does
not depend on the corpus.  The decomposition follows the randomised scheme of Halko, Martinsson and Tropp:

* one reading of the texts sketches a block of rows with a random matrix and adds up the matrix's rows times
  their sketches, a block of columns at a time.  The sketches' inner products follow from those sums, and
  with them the projection of the matrix on the basis of the sketches, so the texts are not read again for it;
* ``power`` repeats the reading, starting from what the projection found instead of random numbers;
* the driver decomposes the projected matrix, whose size the parameters bound.

A text's vector is its row times the right singular vectors: further texts need nothing but the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from docket.operators.tokens import word_tokens
from docket.sources.files import stored

DIM, TERMS, OVERSAMPLE, POWER = 384, 1 << 14, 16, 1
#: Columns of a block that one task sums; parts of a block that one task folds.
BLOCK, FOLD = 256, 16
#: Texts that are sketched and added up at once.
ROWS = 2048


def bags(docs: DataFrame, text_col: str, terms: int = TERMS) -> DataFrame:
    """``docs`` with ``bag``: the hashed terms of the whole text, one entry per word; null texts have none."""
    hashed = F.transform(word_tokens(F.col(text_col)), lambda w: F.pmod(F.xxhash64(w), F.lit(terms)).cast("int"))
    return docs.withColumn("bag", F.coalesce(hashed, F.array().cast("array<int>")))


class Weights:
    """Rows of the matrix: term totals of the corpus that the model is fitted on."""

    def __init__(self, totals: np.ndarray):
        self.totals, self.total = totals, float(totals.sum())

    def rows(self, column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(terms, weights) of each bag; terms that the corpus does not have and terms that a text has no more
        often than by chance are left out."""
        offsets = column.offsets.to_numpy()
        flat = column.values.to_numpy()
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            at, n = np.unique(flat[a:b], return_counts=True)
            known = self.totals[at] > 0
            at, n = at[known], n[known]
            v = np.log(n * self.total / (max(b - a, 1) * self.totals[at])) if len(at) else np.zeros(0)
            at, v = at[v > 0], v[v > 0]
            yield at, v / max(np.linalg.norm(v), 1e-300)


@dataclass
class TextVectors:
    """A fitted model: term totals, right singular vectors (terms x dim), singular values, and the number of texts."""

    weights: Weights
    right: np.ndarray
    values: np.ndarray
    dim: int
    terms: int

    def transform(self, docs: DataFrame, text_col: str = "text", out: str = "features", unit: bool = True) -> DataFrame:
        """``docs`` with the vectors of its texts (array<float> of ``dim``), scaled to length one if ``unit``.
        A text without known terms has the zero vector."""
        spark = docs.sparkSession
        known = spark.sparkContext.broadcast((self.weights, self.right.astype(np.float32)))
        # columns travel under plain names, whatever they are called
        given = [c for c in docs.columns if c != out]
        plain = [f"c{i}" for i in range(len(given))]
        rows = bags(docs.select(*[docs[f"`{c}`"].alias(p) for c, p in zip(given, plain, strict=True)]), plain[given.index(text_col)], self.terms)
        schema = rows.drop("bag").schema.add(out, ArrayType(FloatType()))
        dim = self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, right = known.value
            for batch in batches:
                got = np.zeros((batch.num_rows, dim), np.float32)
                for i, (at, v) in enumerate(weights.rows(batch.column("bag"))):
                    x = v.astype(np.float32) @ right[at]
                    got[i, : len(x)] = x / max(np.linalg.norm(x), 1e-30) if unit else x
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, got.size + 1, dim, dtype=np.int32)), pa.array(got.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in plain), vectors], [*plain, out])

        return rows.mapInArrow(run, schema).toDF(*given, out)


def _binary(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, np.float64).tobytes()


def _add_by_term(total: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> None:
    """Add each row's weights times its sketch (a row of ``y``) to its terms; a term's rows are added together."""
    at = np.concatenate([a for a, _ in rows])
    order = np.argsort(at, kind="stable")
    v = np.concatenate([w for _, w in rows])[order]
    row = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])[order]
    terms, starts = np.unique(at[order], return_index=True)
    for t, a, b in zip(terms.tolist(), starts.tolist(), [*starts[1:].tolist(), len(at)], strict=True):
        total[t] += v[a:b] @ y[row[a:b]]


def _projected(known, terms: int):
    """Per task the sum of the matrix's rows times their sketches, in blocks of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, test = known.value
        total = np.zeros((terms, test.shape[1]))
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                rows = [r for r in weights.rows(batch.column("bag").slice(a, ROWS)) if len(r[0])]
                if rows:
                    _add_by_term(total, rows, np.vstack([v @ test[at] for at, v in rows]))
        for k in range(0, terms, BLOCK):
            if total[k:k + BLOCK].any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([k // BLOCK], pa.int32()), "part": pa.array([_binary(total[k:k + BLOCK])], pa.binary())})

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of a block added up; rows come sorted by block."""
    block, total = None, None
    for batch in batches:
        for r in batch.to_pylist():
            part = np.frombuffer(r["part"])
            if r["block"] != block:
                if block is not None:
                    yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "part": pa.array([_binary(total)], pa.binary())})
                block, total = r["block"], part.copy()
            else:
                total += part
    if block is not None:
        yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "part": pa.array([_binary(total)], pa.binary())})


def fit(docs: DataFrame, text_col: str = "text", dim: int = DIM, terms: int = TERMS, oversample: int = OVERSAMPLE,
        power: int = POWER, seed: int = 42) -> TextVectors:
    """The model of the texts of ``docs``.  An empty corpus gives a model whose vectors are all zero."""
    spark = docs.sparkSession
    rows = stored(bags(docs.select(docs[f"`{text_col}`"].alias("text")), "text", terms).select("bag"), "bags")
    totals = np.zeros(terms)
    for r in rows.select(F.explode("bag").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect():  # at most ``terms`` rows
        totals[r["t"]] = r["n"]
    weights, width = Weights(totals), min(dim + oversample, terms)
    test = np.random.default_rng(seed).standard_normal((terms, width))
    projected = np.zeros((terms, 0))
    for _ in range(1 + power):
        known = spark.sparkContext.broadcast((weights, test))
        parts = rows.mapInArrow(_projected(known, terms), "block int, part binary")
        sums = parts.repartition(max(1, min(-(-terms // BLOCK), rows.rdd.getNumPartitions())), "block").sortWithinPartitions("block").mapInArrow(
            _added, "block int, part binary")
        added = np.zeros((terms, width))
        for r in sums.collect():  # terms * width numbers, whatever the corpus
            added[r["block"] * BLOCK:(r["block"] + 1) * BLOCK] = np.frombuffer(r["part"]).reshape(-1, width)
        # added = A^T Y and Y = A test, so test^T added = Y^T Y = W S^2 W^T, and Y W / S is a basis
        inner = test.T @ added
        square, w = np.linalg.eigh((inner + inner.T) / 2)
        alive = square > max(square.max(initial=0.0), 0.0) * 1e-13
        turn = w[:, alive] / np.sqrt(square[alive])
        if not turn.shape[1]:
            break
        projected = added @ turn
        test = np.linalg.qr(projected)[0]
        width = test.shape[1]
    if not projected.shape[1]:
        return TextVectors(weights, np.zeros((terms, 0)), np.zeros(0), dim, terms)
    # B B^T = U S^2 U^T, and the right singular vectors are B^T U / S
    square, u = np.linalg.eigh(projected.T @ projected)
    order = np.argsort(-square)[:dim]
    values = np.sqrt(np.maximum(square[order], 0.0))
    alive = values > values[0] * 1e-7 if len(values) else np.zeros(0, bool)
    return TextVectors(weights, projected @ u[:, order[alive]] / values[alive], values[alive], dim, terms)
