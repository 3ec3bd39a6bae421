"""The soft-label classifier and its losses (§2.13).

The original trains encoders on a GPU with the KL divergence of a 3-class distribution.  Here text vectors
(``text_vectors``) feed a multinomial model whose loss on soft targets is minimised directly: every step sums
loss and gradient over the stored training rows, per task and then in a tree, and the driver takes a
limited-memory quasi-Newton step on the 3 x (dim + 1) parameters.  Validation rows are measured in the
same pass; training stops when they have not got better for ``patience`` steps, and the best step's parameters stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from docket.functions import arrays as A
from docket.operators.vector_index import matrix
from docket.sources.files import stored

CLASSES = 3
#: Partial sums that one task adds up.
FOLD = 32
#: Rows of a stored matrix.
ROWS = 1024


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _kl(z: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row KL(t || softmax(z)) with t scaled to sum one, and its gradient by z."""
    t = t / t.sum(axis=1, keepdims=True)
    z = z - z.max(axis=1, keepdims=True)
    logp = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    own = np.where(t > 0, t * np.log(np.where(t > 0, t, 1.0)), 0.0)
    return (own - t * logp).sum(axis=1), np.exp(logp) - t


def _mse(z: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the mean squared error of softmax(z) against t as it is, and its gradient by z."""
    p = _softmax(z)
    d = 2.0 * (p - t) / t.shape[1]
    return ((p - t) ** 2).mean(axis=1), p * (d - (d * p).sum(axis=1, keepdims=True))


Loss = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
_LOSSES: dict[str, Loss] = {}
_ROWS: dict[str, Callable[[Column, Column], Column]] = {}


def register_loss(name: str, loss: Loss, row: Callable[[Column, Column], Column]) -> None:
    """Make a loss known by name (any case): its rows and gradients in numpy, and its row value as a column
    expression of (log-probabilities, target)."""
    _LOSSES[name.upper()], _ROWS[name.upper()] = loss, row


def loss_name(name: str | None = None) -> str:
    """The name of a registered loss; KL is the default."""
    key = (name or "KL").upper()
    if key not in _LOSSES:
        raise ValueError(f"Unknown loss '{name}'. Known losses: {sorted(_LOSSES)}")
    return key


register_loss("KL", _kl, lambda logp, t: A.kl_row(logp, t))
register_loss("MSE", _mse, lambda logp, t: A.squared_error_sum(logp, t) / CLASSES)


@dataclass
class Classifier:
    """Weights (classes x dim) and intercepts; ``history`` has (training, validation) loss per step."""

    weights: np.ndarray
    bias: np.ndarray
    loss: str = "KL"
    history: list[tuple[float, float | None]] = field(default_factory=list)

    def score(self, rows: DataFrame, features_col: str = "features") -> DataFrame:
        """``rows`` with ``probs`` (array<double>) and ``pred``, the first of the most probable classes."""
        known = rows.sparkSession.sparkContext.broadcast((self.weights, self.bias))
        # columns travel under plain names, whatever they are called
        names, plain = rows.columns, [f"c{i}" for i in range(len(rows.columns))]
        given = rows.toDF(*plain)
        schema = given.select("*").schema.add("probs", ArrayType(DoubleType()))
        at, classes = plain[names.index(features_col)], len(self.bias)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, b = known.value
            for batch in batches:
                p = _softmax(matrix(batch.column(at)) @ w.T + b) if batch.num_rows else np.zeros((0, classes))
                probs = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, classes, dtype=np.int32)), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, probs], [*plain, "probs"])

        return given.mapInArrow(run, schema).toDF(*names, "probs").withColumn("pred", A.argmax(F.col("probs")))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as matrices, one per batch: features as they come, targets, and which rows are for validation."""
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            x = part.column("features")
            values = [x.flatten().to_numpy(zero_copy_only=False), matrix(part.column("target")).ravel(),
                      part.column("validation").to_numpy(zero_copy_only=False).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([pa.array([v.astype(t).tobytes()], pa.binary()) for v, t in zip(
                values, (np.float64 if values[0].dtype != np.float32 else np.float32, np.float64, np.uint8), strict=True)]
                + [pa.array([values[0].dtype == np.float32])], ["features", "target", "validation", "single"])


def _summed(rows: DataFrame, known) -> np.ndarray:
    """(loss, n, validation loss, validation n, gradient...) over all rows, per task and then in a tree."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b, name_loss = known.value
        total = np.zeros(4 + w.size + b.size)
        for batch in batches:
            for r in batch.to_pylist():
                x = np.frombuffer(r["features"], np.float32 if r["single"] else np.float64).astype(np.float64).reshape(-1, w.shape[1])
                t = np.frombuffer(r["target"]).reshape(len(x), -1)
                value, by_z = name_loss(x @ w.T + b, t)
                train = np.frombuffer(r["validation"], np.uint8) == 0
                total[:4] += value[train].sum(), train.sum(), value[~train].sum(), (~train).sum()
                total[4:4 + w.size] += (by_z[train].T @ x[train]).ravel()
                total[4 + w.size:] += by_z[train].sum(axis=0)
        yield pa.RecordBatch.from_pydict({"part": pa.array([total.tobytes()], pa.binary())})

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(np.frombuffer(p) for batch in batches for p in batch.column("part").to_pylist())
        if isinstance(total, np.ndarray):
            yield pa.RecordBatch.from_pydict({"part": pa.array([total.tobytes()], pa.binary())})

    parts = rows.mapInArrow(one, "part binary")
    left = rows.rdd.getNumPartitions()
    while left > FOLD:
        left = -(-left // FOLD)
        parts = parts.repartition(left).mapInArrow(more, "part binary")
    return np.sum([np.frombuffer(r["part"]) for r in parts.collect()], axis=0)  # at most FOLD rows


def _direction(grad: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The two-loop recursion of limited-memory BFGS."""
    q, kept = grad.copy(), []
    for s, y in reversed(steps):
        a = (s @ q) / (y @ s)
        q -= a * y
        kept.append(a)
    if steps:
        s, y = steps[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(steps, reversed(kept), strict=True):
        q += (a - (y @ q) / (y @ s)) * s
    return -q


def soft_label_classifier(train: DataFrame, validation: DataFrame | None = None, loss: str | None = None, max_iter: int = 30,
                          reg: float = 1e-4, patience: int = 3, memory: int = 8, tolerance: float = 1e-5) -> Classifier:
    """A model of ``target`` (array of class shares; rows without one, or with the unclear sentinel's negative
    shares scaled to uniform ones) from ``features`` (array of numbers).

    ``loss``: a registered name.  The squared weights count ``reg`` / 2.  An empty training table gives
    uniform probabilities."""
    name = loss_name(loss)
    share = F.transform(A.normalize_target(F.col("target")), lambda x: F.greatest(x, F.lit(0.0)))  # an absent share may be negative
    keep = ["features", share.alias("target")]
    rows = train.filter(F.col("target").isNotNull() & F.col("features").isNotNull()).select(*keep, F.lit(False).alias("validation"))
    if validation is not None:
        rows = rows.unionByName(validation.filter(F.col("target").isNotNull() & F.col("features").isNotNull())
                                .select(*keep, F.lit(True).alias("validation")))
    first = rows.select(F.size("features")).head()
    dim = first[0] if first else 0
    # every step reads them: bytes of matrices, not arrays value by value
    rows = stored(rows.mapInArrow(_packed, "features binary, target binary, validation binary, single boolean"), "training-rows")
    spark, size = rows.sparkSession, CLASSES * dim
    history: list[tuple[float, float | None]] = []

    def measured(x: np.ndarray) -> tuple[float, np.ndarray, float | None]:
        w, b = x[:size].reshape(CLASSES, dim), x[size:]
        known = spark.sparkContext.broadcast((w, b, _LOSSES[name]))
        total = _summed(rows, known)
        known.unpersist()
        n = max(total[1], 1.0)
        grad = total[4:] / n
        grad[:size] += reg * x[:size]
        return total[0] / n + 0.5 * reg * (x[:size] @ x[:size]), grad, total[2] / total[3] if total[3] else None

    x = np.zeros(size + CLASSES)
    if not dim:
        return Classifier(x[:size].reshape(CLASSES, dim), x[size:], name, history)
    value, grad, held = measured(x)
    history.append((value, held))
    best, best_x, worse = held if held is not None else value, x, 0
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_iter):
        if np.abs(grad).max() < tolerance:
            break
        move = _direction(grad, steps)
        scale = 1.0 if steps else min(1.0, 1.0 / max(np.abs(grad).sum(), 1e-12)) * 10
        for _ in range(8):
            new, new_grad, held = measured(x + scale * move)
            if new <= value + 1e-4 * scale * (grad @ move):
                break
            scale *= 0.4
        else:
            break
        s, y = scale * move, new_grad - grad
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-memory:]
        x, value, grad = x + s, new, new_grad
        history.append((value, held))
        now = held if held is not None else value
        if now < best:
            best, best_x, worse = now, x, 0
        else:
            worse += 1
            if worse >= patience:
                break
    return Classifier(best_x[:size].reshape(CLASSES, dim), best_x[size:], name, history)


def evaluate(scored: DataFrame, target_col: str = "target", loss: str | None = None) -> DataFrame:
    """One row: the mean of a registered loss (column ``loss``), macro-F1 over the three classes with the
    target's arg-max as truth, and n."""
    name = loss_name(loss)
    logp = F.transform("probs", lambda p: F.log(F.greatest(p, F.lit(1e-12))))
    s = scored.select(_ROWS[name](logp, F.col(target_col)).alias("loss"), A.argmax(F.col(target_col)).alias("truth"), "pred")
    per = [F.struct(F.count_if((F.col("truth") == c) & (F.col("pred") == c)).alias("both"), F.count_if(F.col("truth") == c).alias("t"),
                    F.count_if(F.col("pred") == c).alias("p")).alias(f"c{c}") for c in range(CLASSES)]
    one = s.agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("n"), *per)
    f1 = [F.when(F.col(f"c{c}.t") + F.col(f"c{c}.p") == 0, F.lit(1.0))
          .otherwise(2.0 * F.col(f"c{c}.both") / (F.col(f"c{c}.t") + F.col(f"c{c}.p"))) for c in range(CLASSES)]
    return one.select(F.round("loss", 6).alias("loss"), F.round(sum(f1[1:], f1[0]) / CLASSES, 6).alias("f1_macro"), "n")
