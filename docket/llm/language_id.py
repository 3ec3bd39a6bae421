"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Document frequencies come from all rows that may be learnt from. The weights are fitted on a
bounded sample of labelled rows, as even as possible over the languages, by follow the regularised
leader with per-coordinate rates and elastic-net penalties: coordinates that never outgrow the L1
penalty stay exactly zero. A fifth of the sample is kept from the fit and sets the temperature that
makes the probabilities fit their hit rate.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docket.llm.chars import held_out, letters, ngrams, share

ORDERS = (1, 2, 3)
BITS = 15
#: Labelled rows that the weights are fitted on, at most.
FITTED_ON = 6000
#: Rates and penalties of the fit.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.01, 2
UNKNOWN = "und"


class Model(NamedTuple):
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (features, languages)
    bias: np.ndarray
    temperature: float


def counts(text: str) -> np.ndarray:
    """How often each feature occurs."""
    code = letters(text)
    return np.bincount(np.concatenate([ngrams(code, n, BITS) for n in ORDERS]), minlength=1 << BITS)


def tf_idf(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, values) of length 1, with sublinear term frequencies."""
    c = counts(text)
    i = np.flatnonzero(c)
    v = (1 + np.log(c[i])) * idf[i]
    return i, v / max(np.linalg.norm(v), 1e-12)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], features: int, classes: int, alpha: float = ALPHA, beta: float = BETA,
         l1: float = L1, l2: float = L2, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias from (features, values, class) rows, in the order given."""
    z = np.zeros((features + 1, classes))
    n = np.zeros_like(z)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for i, v, y in rows:
            i, v = np.append(i, features), np.append(v, 1.0)
            w = weights(i)
            p = softmax(v @ w)
            p[y] -= 1
            g = v[:, None] * p
            more = n[i] + g * g
            z[i] += g - (np.sqrt(more) - np.sqrt(n[i])) / alpha * w
            n[i] = more
    w = weights(np.arange(features + 1))
    return w[:-1], w[-1]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by golden-section search over its logarithm.

    Targets are smoothed by one case in len(y) + 2, so that rows without an error do not give certainty.
    """
    if not len(y):
        return 1.0

    slip = 1 / (len(y) + 2)

    def loss(t):
        p = np.log(np.maximum(softmax(logits / np.exp(t)), 1e-12))
        hit = p[np.arange(len(y)), y]
        return -((1 - slip) * hit + slip * (p.sum(1) - hit) / max(1, p.shape[1] - 1)).mean()

    a, b, ratio = -5.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for text in batch.column("text").to_pylist():
            df += counts(text) > 0
            n += 1
    i = np.flatnonzero(df)
    yield pa.RecordBatch.from_pydict({"feature": pa.array([*i, -1], pa.int32()), "df": pa.array([*df[i], n], pa.int64())})


def train(docs: DataFrame, fitted_on: int = FITTED_ON) -> Model | None:
    """The model from (doc_id, text, lang) rows that are not held out; None without labelled rows."""
    spark = docs.sparkSession
    learnt = docs.filter(~held_out(F.col("doc_id")))
    idf = np.zeros(1 << BITS)
    # 2^15 features at most, whatever the documents
    counted = learnt.select("text").mapInArrow(_frequencies, "feature int, df long").groupBy("feature").agg(F.sum("df").alias("df")).toArrow()
    seen = dict(zip(counted.column("feature").to_pylist(), counted.column("df").to_pylist(), strict=True))
    n = seen.pop(-1, 0)
    idf[list(seen)] = list(seen.values())
    idf = np.log((1 + n) / (1 + idf)) + 1
    labelled = learnt.filter("lang is not null")
    per = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not per:
        return None
    languages = sorted(per)
    fractions = F.create_map(*(x for k in languages for x in (F.lit(k), F.lit(fitted_on / len(per) / per[k]))))
    sample = labelled.filter(share(F.col("doc_id")) < F.element_at(fractions, F.col("lang")))
    shared = spark.sparkContext.broadcast(idf)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [tf_idf(t, shared.value) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("lang"),
                                              pa.array([i.astype("<u2").tobytes() for i, _ in rows], pa.binary()),
                                              pa.array([v.astype("<f4").tobytes() for _, v in rows], pa.binary())],
                                             ["order", "lang", "features", "values"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["order"], r["lang"], r["features"]))
        data = [(np.frombuffer(r["features"], "<u2").astype(np.int64), np.frombuffer(r["values"], "<f4").astype(float),
                 languages.index(r["lang"])) for r in rows]
        fitted, kept = [d for k, d in enumerate(data) if k % 5], data[::5]
        w, bias = ftrl(fitted or data, 1 << BITS, len(languages))
        logits = np.array([v @ w[i] + bias for i, v, _ in kept])
        t = temperature(logits, np.array([y for _, _, y in kept]))
        yield pa.RecordBatch.from_pydict({"weights": pa.array([w.astype("<f8").tobytes()], pa.binary()),
                                          "bias": pa.array([bias.astype("<f8").tobytes()], pa.binary()), "temperature": pa.array([t])})

    rows = sample.select(F.xxhash64("doc_id").alias("order"), "lang", "text").mapInArrow(
        vectors, "order long, lang string, features binary, values binary")
    row = rows.orderBy("order").limit(2 * fitted_on).coalesce(1).mapInArrow(fit, "weights binary, bias binary, temperature double").head()
    return Model(languages, idf, np.frombuffer(row.weights, "<f8").reshape(1 << BITS, -1), np.frombuffer(row.bias, "<f8"), row.temperature)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             fitted_on: int = FITTED_ON, whole: bool = False) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score (calibrated probability); with
    ``whole`` also ``row``, the input row as a struct.

    ``und`` with score 0: null texts, texts without a letter, and all texts where there is no
    labelled row. Null ids are learnt from. Repeated rows give rows of their own. An empty table
    gives no rows. The label of a row is never an input of its prediction.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       F.col(lang_col).alias("lang"), *([F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")] if whole else []))
    shared = docs.sparkSession.sparkContext.broadcast(train(rows.select("doc_id", "text", "lang"), fitted_on))
    kept = ["doc_id", "held_out", *(["row"] if whole else [])]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            langs, scores = [], []
            for text in batch.column("text").to_pylist():
                if m is None or not any(map(str.isalpha, text)):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                i, v = tf_idf(text, m.idf)
                p = softmax((v @ m.weights[i] + m.bias) / m.temperature)
                langs.append(m.languages[int(p.argmax())])
                scores.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             [*kept, "lang_pred", "score"])

    asked = rows.withColumn("held_out", held_out(F.col("doc_id"))).select(*kept, "text")
    schema = StructType(asked.drop("text").schema.fields + StructType.fromDDL("lang_pred string, score double").fields)
    return asked.mapInArrow(predict, schema)
