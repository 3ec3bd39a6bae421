"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted lists.

Terms are hashed five-character pieces of words (a space marks either end of a word). Counts over
all distinct labelled texts that may be learnt from choose the terms that tell labels apart: those for
which the lower bound of the toxic share among the texts that hold them (Wilson's interval, ``Z``)
has at least ``LEAST_ODDS`` times the odds of all texts. The bound is a rate, so a larger table does not
admit weaker terms. Examples are a bounded sample of the same texts, of each label up to half of it; a
sampled example counts for as many as it stands for. Their inverted lists are cut
into blocks of consecutive examples, each with its largest weight per term; a text visits blocks in
falling order of their bound and stops where no block can beat its k-th neighbour, so the
neighbours are exact. Cosine-weighted votes are calibrated by isotonic regression on the examples'
own leave-one-out votes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docket.llm.chars import SPACE, held_out, letters, ngrams, share
from docket.llm.common import stored

WIDTH, BITS = 5, 20
Z, LEAST_ODDS = 1.6, 8.0
#: Bounds of the fitted model: labelled rows as examples, neighbours, examples in a block.
EXAMPLES, NEIGHBOURS, BLOCK = 16_384, 25, 128
#: Blocks that set the cosine to beat.
FIRST = 4
#: Weight of the base rate in a vote.
PRIOR_WEIGHT = 0.1
THRESHOLD = 0.3


def terms(text: str) -> np.ndarray:
    """Hashed pieces of words, repeated as they occur."""
    code = letters(text)
    if len(code) < WIDTH:
        return ngrams(np.concatenate([code, np.full(WIDTH - len(code), SPACE, np.uint32)]), WIDTH, BITS)
    inside = np.cumsum(np.concatenate([[0], code == SPACE]))
    within = inside[WIDTH - 1: len(code)] - inside[1: len(code) - WIDTH + 2] == 0
    short = _short(code)
    return np.concatenate([ngrams(code, WIDTH, BITS)[within], short])


def _short(code: np.ndarray) -> np.ndarray:
    """Words of one or two letters, too short for a piece, as a whole."""
    at = np.flatnonzero(code == SPACE)
    out = []
    for n in (1, 2):
        starts = at[:-1][np.diff(at) == n + 1]
        if len(starts):
            rows = code[starts[:, None] + np.arange(n + 2)]
            h = np.zeros(len(rows), np.uint32)
            for k in range(n + 2):
                h = h * np.uint32(0x01000193) ^ rows[:, k]
            out.append((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


class Index(NamedTuple):
    """The fitted model: terms of the hash space and at most EXAMPLES examples."""

    column: np.ndarray  # term -> column, -1 for terms that were not chosen
    idf: np.ndarray
    ids: np.ndarray  # documents of the examples, blocks are runs of BLOCK of them
    toxic: np.ndarray
    stands: np.ndarray  # labelled texts that an example stands for
    cells: np.ndarray  # column -> first of its cells, the blocks that hold it; one more at the end
    block: np.ndarray  # of a cell
    highest: np.ndarray  # largest weight in a cell
    starts: np.ndarray  # cell -> first posting; one more at the end
    example: np.ndarray
    weight: np.ndarray
    prior: float
    steps: tuple[np.ndarray, np.ndarray]  # isotonic calibration: votes, rates


def vector(text: str, column: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(columns, values) of length 1 over the chosen terms; nothing where none occurs."""
    c = column[terms(text)]
    i, n = np.unique(c[c >= 0], return_counts=True)
    v = (1 + np.log(n)) * idf[i]
    return i, v / max(np.linalg.norm(v), 1e-12)


def build(column: np.ndarray, idf: np.ndarray, rows: list[tuple[int, int, np.ndarray, np.ndarray]], stands=(1.0, 1.0)) -> Index:
    """The index of (document, toxic, columns, values) rows; ``stands``: rows that one example of either label stands for."""
    n, blocks = len(rows), -(-len(rows) // BLOCK)
    example = np.repeat(np.arange(n), [len(r[2]) for r in rows])
    cols = np.concatenate([r[2] for r in rows]) if rows else np.zeros(0, np.int64)
    weight = np.concatenate([r[3] for r in rows]) if rows else np.zeros(0)
    order = np.lexsort((example, cols))
    example, cols, weight = example[order], cols[order], weight[order]
    cell = cols * blocks + example // BLOCK
    starts = np.flatnonzero(np.diff(cell, prepend=-1))
    highest = np.maximum.reduceat(weight, starts) if len(starts) else np.zeros(0)
    held, block = np.divmod(cell[starts], max(1, blocks))
    cells = np.searchsorted(held, np.arange(len(idf) + 1))
    toxic = np.array([r[1] for r in rows], float)
    each = np.where(toxic > 0, stands[1], stands[0])
    prior = float((each @ toxic + 1) / (each.sum() + 2))
    return Index(column, idf, np.array([r[0] for r in rows], np.int64), toxic, each, cells, block, highest,
                 np.append(starts, len(cell)), example, weight, prior, (np.zeros(1), np.full(1, prior)))


def nearest(index: Index, cols: np.ndarray, values: np.ndarray, k: int = NEIGHBOURS, but: int = -1) -> list[tuple[float, int]]:
    """The k examples of highest positive cosine, (cosine, example), ties to the earlier example; ``but`` is left out.

    A few blocks of the highest bounds give a k-th cosine to beat. Of the others only those whose
    bound reaches it are read, block by block while they are few, else list by list.
    """
    blocks = -(-len(index.ids) // BLOCK)
    if not len(cols) or not blocks:
        return []
    rows = list(zip(index.cells[cols].tolist(), index.cells[cols + 1].tolist(), values.tolist(), strict=True))
    bounds = np.zeros(blocks)
    for a, z, v in rows:
        bounds[index.block[a:z]] += v * index.highest[a:z]
    order = np.argsort(-bounds, kind="stable")
    order = order[: int((bounds > 0).sum())]
    scores = np.zeros(blocks * BLOCK)

    def read(some: list[int]) -> None:
        wanted = np.zeros(blocks, bool)
        wanted[some] = True
        for first, end, v in rows:
            for i in (first + np.flatnonzero(wanted[index.block[first:end]])).tolist():
                a, z = index.starts[i], index.starts[i + 1]
                scores[index.example[a:z]] += v * index.weight[a:z]

    read(order[:FIRST].tolist())
    if but >= 0:
        scores[but] = 0
    seen = np.sort(scores[np.concatenate([np.arange(b * BLOCK, (b + 1) * BLOCK) for b in order[:FIRST]])]) if len(order) else scores[:0]
    least = seen[-k] if len(seen) >= k else 0.0
    rest = [b for b in order[FIRST:].tolist() if bounds[b] >= least - 1e-12]
    if len(rest) > 2 * FIRST:
        scores[:] = 0
        for first, end, v in rows:
            a, z = index.starts[first], index.starts[end]
            scores[index.example[a:z]] += v * index.weight[a:z]
    else:
        read(rest)
    if but >= 0:
        scores[but] = 0
    hit = np.flatnonzero(scores >= max(least - 1e-12, 1e-12))
    best = hit[np.argsort(-scores[hit], kind="stable")[:k]]
    return list(zip(scores[best].tolist(), best.tolist(), strict=True))


def vote(index: Index, found: list[tuple[float, int]]) -> float:
    """Share of toxic neighbours, weighted by squared cosine, drawn to the base rate."""
    at = [i for _, i in found]
    w = np.array([s * s for s, _ in found]) * index.stands[at] if found else np.zeros(0)
    y = index.toxic[at] if found else w
    return float((w @ y + PRIOR_WEIGHT * index.prior) / (w.sum() + PRIOR_WEIGHT))


def isotonic(votes: np.ndarray, y: np.ndarray, stands: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rates that do not fall with the vote (pool adjacent violators), one case of each kind added to a pool."""
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []
    each = np.ones(len(y)) if stands is None else stands
    x, first = votes[order], np.flatnonzero(np.concatenate([[True], np.diff(votes[order]) > 1e-9]))
    for a, b in zip(first, [*first[1:], len(x)], strict=True):
        pools.append([x[a], float((y * each)[order][a:b].sum()), float(each[order][a:b].sum())])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, s, n = pools.pop()
            pools[-1][1] += s
            pools[-1][2] += n
    rates = np.array([(s + 0.1) / (n + 0.2) for _, s, n in pools])
    return np.array([p[0] for p in pools]), np.maximum.accumulate(rates)


def calibrated(index: Index, raw: float) -> float:
    votes, rates = index.steps
    return float(np.clip(np.interp(raw, votes, rates), 0, 1))


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros((2, (1 << BITS) + 1), np.int32)
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            df[toxic, np.unique(terms(text))] += 1
            df[toxic, -1] += 1
    i = np.flatnonzero(df.any(0))
    yield pa.RecordBatch.from_pydict({"term": pa.array(i, pa.int32()), "clean": pa.array(df[0, i], pa.int64()), "toxic": pa.array(df[1, i], pa.int64())})


def chosen_terms(learnt: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(term -> column, idf): terms that tell the labels apart, over all (text, toxic) rows."""
    n = learnt.select("text", "toxic").mapInArrow(_presence, "term int, clean long, toxic long").groupBy("term").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).cache()
    column = np.full(1 << BITS, -1, np.int32)
    total = n.filter(F.col("term") == 1 << BITS).head()
    if total is None or not total.clean or not total.toxic:
        n.unpersist()
        return column, np.zeros(0)
    c, t = float(total.clean), float(total.toxic)

    seen = F.col("clean") + F.col("toxic")
    rate, z = F.col("toxic") / seen, Z * Z
    low = (rate + z / (2 * seen) - Z * F.sqrt(rate * (1 - rate) / seen + z / (4 * seen * seen))) / (1 + z / seen)
    best = n.filter(F.col("term") < 1 << BITS).filter(low * c >= LEAST_ODDS * t * (1 - low)).orderBy(
        "term").select("term", seen.alias("df")).toArrow()  # at most 2^BITS rows
    n.unpersist()
    column[best.column("term").to_numpy()] = np.arange(len(best))
    return column, np.log((1 + c + t) / (1 + best.column("df").to_numpy().astype(float))) + 1


def train(rows: DataFrame, labels: DataFrame, label_id: str = "doc_id", label_col: str = "toxic", examples: int = EXAMPLES) -> Index:
    """The index from (doc_id, text) rows and their labels. A document with several label rows is toxic if one says so."""
    marks = labels.select(F.col(label_id).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).filter(
        "doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    open_rows = rows.filter(~held_out(F.col("doc_id")))
    # of equal texts one row is learnt from: only digests are grouped, and the row is found by its id and digest
    digest = F.unhex(F.md5("text"))
    apart = open_rows.select("doc_id", digest.alias("digest")).join(marks.hint("merge"), "doc_id").groupBy("digest").agg(
        F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    learnt = stored(open_rows.withColumn("digest", digest).join(apart.hint("merge"), ["doc_id", "digest"]).dropDuplicates(
        ["doc_id", "digest"]).select("doc_id", "text", "toxic"), "labelled-texts")
    column, idf = chosen_terms(learnt)
    n = {r.toxic: r["count"] for r in learnt.groupBy("toxic").count().collect()}
    few = min(n.get(0, 0), n.get(1, 0), examples // 2)  # the rarer label gets its half, the other one the rest
    part = [min(1.0, max(few, examples - min(n.get(1 - y, 0), examples // 2)) / max(1, n.get(y, 0))) for y in (0, 1)]
    shared = rows.sparkSession.sparkContext.broadcast((column, idf))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [vector(t, *shared.value) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array([i.tolist() for i, _ in out], pa.list_(pa.int64())),
                                              pa.array([v.tolist() for _, v in out], pa.list_(pa.float64()))], ["doc_id", "toxic", "cols", "vals"])

    sample = learnt.filter(share(F.col("doc_id")) < F.when(F.col("toxic") == 1, part[1]).otherwise(part[0]))
    found = sample.select("doc_id", "toxic", "text").mapInArrow(vectors, "doc_id long, toxic int, cols array<long>, vals array<double>")
    got = sorted(found.limit(2 * examples).collect(), key=lambda r: (r.doc_id, r.cols))  # bounded by ``examples``
    index = build(column, idf, [(r.doc_id, r.toxic, np.array(r.cols, np.int64), np.array(r.vals)) for r in got], [1 / max(p, 1e-12) for p in part])
    if not got:
        return index
    own = [vote(index, nearest(index, np.array(r.cols, np.int64), np.array(r.vals), but=k)) for k, r in enumerate(got)]
    return index._replace(steps=isotonic(np.array(own), index.toxic, index.stands))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", examples: int = EXAMPLES,
             whole: bool = False) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, evidence (document, cosine and label
    of the nearest examples); with ``whole`` also ``row``, the input row as a struct.

    Texts without a chosen term (null, empty and most clean ones) have no neighbours and the rate of
    such examples as score. Without labels of both kinds nothing is chosen and every score is the
    base rate. Null ids have no label; repeated rows give rows of their own; an empty table gives none.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       *([F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")] if whole else []))
    shared = docs.sparkSession.sparkContext.broadcast(train(rows.select("doc_id", "text"), labels, examples=examples))
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
    kept = ["doc_id", "held_out", *(["row"] if whole else [])]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            scores, evidence = [], []
            for text in batch.column("text").to_pylist():
                found = nearest(index, *vector(text, index.column, index.idf))
                scores.append(calibrated(index, vote(index, found)))
                evidence.append([{"doc_id": int(index.ids[i]), "cosine": s, "toxic": int(index.toxic[i])} for s, i in found[:5]])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(scores, pa.float64()),
                 pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array(evidence, kind)],
                [*kept, "score", "predicted", "evidence"])

    asked = rows.withColumn("held_out", held_out(F.col("doc_id"))).select(*kept, "text")
    schema = StructType(asked.drop("text").schema.fields + StructType.fromDDL("score double, predicted int, evidence array<struct<doc_id:long,cosine:double,toxic:int>>").fields)
    return asked.mapInArrow(predict, schema)
