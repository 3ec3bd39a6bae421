"""Exact vector searches over a clustered index.

The index deals the vectors to clusters of similar direction (centroids fitted on at most ``SAMPLE`` rows;
every row is indexed) and packs them, by cluster and angle to the centroid, into cells of at most ``CELL``
vectors: one shuffle, one write.  Angles obey the triangle inequality, so a cell whose angles lie between
``low`` and ``high`` has no vector closer to a query than the gap between that interval and the query's own
angle to the centroid.  Cells that cannot hold a wanted vector are pruned before their vectors are touched,
and clusters without a cell that is left are not read; the others are scanned where they lie.

Queries go to the cells: they are collected and broadcast in rounds of at most ``ROUND_BYTES``, cluster by
cluster, so a round wants few clusters and a large query set takes more rounds.  For the k best, a first
look into each query's own cluster gives the bound that the second look prunes by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docket.session import scratch_path

#: Rows that the centroids are fitted on, at most; centroids, at most; vectors of a cell, at most.
SAMPLE, CENTROIDS, CELL = 8192, 256, 1024
#: Bytes of query vectors that one round broadcasts.
ROUND_BYTES = 32 << 20
#: Similarities are compared after rounding to so many digits.
DIGITS = 9
#: Slack of a bound against rounding in angles.
_SLACK = 1e-7


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long number lists as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _angles(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(x) @ centroids.T, -1.0, 1.0))


def centroids_of(rows: DataFrame, sample: int = SAMPLE, most: int = CENTROIDS, turns: int = 6) -> np.ndarray:
    """Unit centroids of (id, v), fitted on the rows of least id hash, ``sample`` at most."""
    got = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()
    x = matrix(got.column("v").combine_chunks()) if got.num_rows else np.zeros((0, 1))
    if not len(x):
        return np.zeros((0, 1))
    x = _unit(x)
    c = x[:: max(1, len(x) // max(1, min(most, len(x) // 16)))][:most].copy()
    for _ in range(turns):
        own = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        alive = np.linalg.norm(total, axis=1) > 1e-12
        c[alive] = _unit(total[alive])
    return c


def _assigned(known):
    """(id, v, cluster, angle): every row's nearest centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                angles = _angles(matrix(batch.column("v")), known.value)
                own = np.argmin(angles, axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(angles[np.arange(len(own)), own])],
                                                 ["id", "v", "cluster", "angle"])

    return run


def _cells(cell: int):
    """Consecutive rows of one cluster, packed; rows come sorted by (cluster, angle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster = batch.column("cluster").to_numpy()
            angle, ids, x = batch.column("angle").to_numpy(), batch.column("id").to_numpy(), matrix(batch.column("v"))
            norms = np.linalg.norm(x, axis=1)
            edges = np.flatnonzero(np.concatenate([[True], cluster[1:] != cluster[:-1], [True]]))
            out = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                for i in range(a, b, cell):
                    j = min(i + cell, b)
                    out.append((int(cluster[i]), float(angle[i]), float(angle[j - 1]), float(norms[i:j].min()), float(norms[i:j].max()),
                                ids[i:j].astype(np.int64).tobytes(), x[i:j].tobytes()))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(_CELL, r, strict=True)) for r in out], schema=_CELL_SCHEMA)

    return run


_CELL = ("cluster", "low", "high", "short", "long", "ids", "vectors")
_CELL_SCHEMA = pa.schema([("cluster", pa.int32()), *((c, pa.float64()) for c in _CELL[1:5]), ("ids", pa.binary()), ("vectors", pa.binary())])
_CELL_DDL = "cluster int, low double, high double, short double, long double, ids binary, vectors binary"


class VectorIndex:
    """The cells of ``vecs`` (a long id and an array of numbers; rows without an id or a vector match nothing)."""

    def __init__(self, vecs: DataFrame, id_col: str, vec_col: str, sample: int = SAMPLE, most: int = CENTROIDS, cell: int = CELL):
        self.spark = vecs.sparkSession
        rows = vecs.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).dropna()
        self.centroids = centroids_of(rows, sample, most)
        self.known = self.spark.sparkContext.broadcast(self.centroids)
        self.path = scratch_path(self.spark, "vector-cells")
        order = ["cluster", "angle", "id"]
        packed = self.assigned(rows).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_cells(cell), _CELL_DDL)
        packed.write.partitionBy("cluster").parquet(self.path)
        self.cells = self.spark.read.schema("low double, high double, short double, long double, ids binary, vectors binary, cluster int").parquet(self.path)
        #: per cluster the reach of its cells: at most ``CENTROIDS`` rows
        self.reach = {r["cluster"]: (r["low"], r["high"], r["short"], r["long"]) for r in self.cells.groupBy("cluster").agg(
            F.min("low").alias("low"), F.max("high").alias("high"), F.min("short").alias("short"), F.max("long").alias("long")).collect()}

    def assigned(self, rows: DataFrame) -> DataFrame:
        if not len(self.centroids):
            return rows.select("id", "v", F.lit(0).alias("cluster"), F.lit(0.0).alias("angle")).limit(0)
        kind = rows.schema["v"].dataType.simpleString()
        return rows.mapInArrow(_assigned(self.known), f"id long, v {kind}, cluster int, angle double")

    def rounds(self, queries: DataFrame, id_col: str, vec_col: str, round_bytes: int = ROUND_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, vectors) of the queries, at most about ``round_bytes`` at a time, clusters together."""
        given = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).dropna()
        most = max(1, round_bytes // (8 * self.centroids.shape[1]))
        if not self.reach:
            return
        one = given.limit(most + 1).toArrow()
        if one.num_rows <= most:  # a single round needs no order
            if one.num_rows:
                yield one.column("id").to_numpy(), matrix(one.column("v").combine_chunks())
            return
        rows = self.assigned(given)
        sizes = {r["cluster"]: r["n"] for r in rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()}
        todo: list[tuple[list[int], int, int]] = []
        held = 0
        for cluster, n in sorted(sizes.items()):
            parts = -(-n // most)
            if parts > 1:
                todo += [([cluster], p, parts) for p in range(parts)]
                held = most
            elif todo and held + n <= most:
                todo[-1][0].append(cluster)
                held += n
            else:
                todo.append(([cluster], 0, 1))
                held = n
        for clusters, part, parts in todo:
            some = rows.filter(F.col("cluster").isin(clusters) & (F.pmod(F.xxhash64("id"), F.lit(parts)) == part))
            got = some.select("id", "v").toArrow()
            if got.num_rows:
                yield got.column("id").to_numpy(), matrix(got.column("v").combine_chunks())


def most_possible(angles: np.ndarray, norms: np.ndarray, low, high, short, long) -> np.ndarray:
    """The largest dot product that queries (angles to a centroid, lengths) can have with vectors whose angles to
    it lie in [low, high] and lengths in [short, long]."""
    gap = np.maximum(0.0, np.maximum(angles - high, low - angles) - _SLACK)
    cos = np.cos(np.minimum(gap, np.pi))
    return norms * np.where(cos >= 0, long, short) * cos + _SLACK


def _scan(known, k: int | None, with_itself: bool):
    """(qid, cid, sim) of the pairs of a cell that reach the query's bound, its ``k`` best ones at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, qids, queries, bounds, homes = known.value
        norms = np.linalg.norm(queries, axis=1)
        angles = _angles(queries, centroids)
        for batch in batches:
            cells = batch.select(["cluster", *_CELL[1:5]]).to_pylist()
            out = []
            for i, c in enumerate(cells):
                most = most_possible(angles[:, c["cluster"]], norms, c["low"], c["high"], c["short"], c["long"])
                wanted = np.flatnonzero((most >= bounds) if homes is None else (homes == c["cluster"]))
                if not len(wanted):
                    continue
                ids = np.frombuffer(batch.column("ids")[i].as_py(), np.int64)
                x = np.frombuffer(batch.column("vectors")[i].as_py(), np.float64).reshape(len(ids), -1)
                # queries in pieces, so that the products of a cell stay small
                for at in np.array_split(wanted, -(-len(wanted) // 2048)):
                    sims = np.round(queries[at] @ x.T, DIGITS)
                    if not with_itself:
                        sims[qids[at][:, None] == ids[None, :]] = -np.inf
                    if k and k < len(ids):
                        kth = np.partition(sims, len(ids) - k, axis=1)[:, len(ids) - k]
                        rows, cols = np.nonzero((sims >= np.maximum(bounds[at], kth)[:, None]) & np.isfinite(sims))
                    else:
                        rows, cols = np.nonzero((sims >= bounds[at][:, None]) & np.isfinite(sims))
                    if len(rows):
                        out.append((qids[at][rows], ids[cols], sims[rows, cols]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["qid", "cid", "sim"])

    return run


_PAIR = "qid long, cid long, sim double"


def _best(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.col("sim").desc(), F.col("cid").asc())
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _searched(index: VectorIndex, qids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int | None, with_itself: bool,
              home: bool = False) -> DataFrame:
    """One round over the cells that may hold a wanted vector; ``home``: over each query's own cluster."""
    angles, norms = _angles(queries, index.centroids), np.linalg.norm(queries, axis=1)
    homes = np.argmin(angles, axis=1) if home else None
    keep, wanted = F.lit(False), []
    for cluster, reach in index.reach.items():
        at = (homes == cluster) if home else (most_possible(angles[:, cluster], norms, *reach) >= bounds)
        if at.any():
            wanted.append(cluster)
            if not home:
                # vectors further than this from all wanting queries' angles are out of reach
                cos = np.clip((bounds[at] - _SLACK) / np.maximum(norms[at] * reach[3], 1e-300), -1.0, 1.0)
                far = np.where(cos > 0, np.arccos(cos), np.pi) + 2 * _SLACK
                keep = keep | ((F.col("cluster") == cluster) & (F.col("high") >= float((angles[at, cluster] - far).min()))
                               & (F.col("low") <= float((angles[at, cluster] + far).max())))
    cells = index.cells.filter(F.col("cluster").isin(wanted))
    known = index.spark.sparkContext.broadcast((index.centroids, qids, queries, bounds, homes))
    return (cells if home else cells.filter(keep)).mapInArrow(_scan(known, k, with_itself), _PAIR)


def nearest(queries: DataFrame, vecs: DataFrame, id_col: str, vec_col: str, k: int = 1, with_itself: bool = False,
            index: VectorIndex | None = None, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(qid, cid, sim, rank): the ``k`` vectors of largest dot product with every query (other than those of its
    own id, unless ``with_itself``), rounded to ``DIGITS``, ties to the smaller id.  Fewer vectors than k give
    fewer rows; an empty side gives none."""
    index = index or VectorIndex(vecs, id_col, vec_col)
    out = None
    for qids, q in index.rounds(queries, id_col, vec_col, round_bytes):
        open_ = np.full(len(qids), -np.inf)
        first = _best(_searched(index, qids, q, open_, k, with_itself, home=True), k)
        worst = first.groupBy("qid").agg(F.min("sim").alias("bound"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
        bound = {r["qid"]: r["bound"] for r in worst.collect()}  # a round's queries
        bounds = np.array([bound.get(i, -np.inf) for i in qids.tolist()])
        found = _best(_searched(index, qids, q, bounds, k, with_itself), k)
        out = found if out is None else out.unionByName(found)
    return index.spark.createDataFrame([], _PAIR + ", rank int") if out is None else out


def at_least(queries: DataFrame, vecs: DataFrame, id_col: str, vec_col: str, threshold: float,
             index: VectorIndex | None = None, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(qid, cid, sim) of all vectors of other ids whose dot product with a query, rounded to ``DIGITS``, is at
    least ``threshold``."""
    index = index or VectorIndex(vecs, id_col, vec_col)
    out = None
    for qids, q in index.rounds(queries, id_col, vec_col, round_bytes):
        found = _searched(index, qids, q, np.full(len(qids), float(threshold)), None, False)
        out = found if out is None else out.unionByName(found)
    return index.spark.createDataFrame([], _PAIR) if out is None else out


def _counted(known):
    """(qid, n): how many rows of the task's are more similar to a query than its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, queries, own = known.value
        n = np.zeros(len(qids), np.int64)
        for batch in batches:
            x = matrix(batch.column("t"))
            for a in range(0, len(x), 1024):
                for b in range(0, len(qids), 2048):
                    sims = np.round(queries[b:b + 2048] @ x[a:a + 1024].T, DIGITS)
                    n[b:b + 2048] += (sims > own[b:b + 2048, None]).sum(axis=1)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["row", "n"])

    return run


def own_ranks(queries: DataFrame, pairs: DataFrame, id_col: str, student_col: str, teacher_col: str,
              round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(id, rank): for every query row the rank of its own teacher vector among the teachers of all rows of
    ``pairs``, 1 + the number of teachers more similar to its student, similarities rounded to ``DIGITS``.

    Queries are broadcast in rounds of at most ``round_bytes``; the rows are read where they lie, and only
    counts move.  Rows without a vector, and queries without an id, take no part."""
    spark = pairs.sparkSession
    teachers = pairs.select(F.col(teacher_col).alias("t")).filter(F.col("t").isNotNull())
    rows = queries.select(F.col(id_col).cast("long").alias("id"), F.col(student_col).alias("s"), F.col(teacher_col).alias("t")).dropna()
    size = rows.agg(F.sum(F.size("s") + F.lit(1)) * 8).head()[0] or 0
    parts = int(size // round_bytes) + 1
    out = spark.createDataFrame([], "id long, rank long")
    for part in range(parts):
        got = rows.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).toArrow()
        if not got.num_rows:
            continue
        qids, s, t = got.column("id").to_numpy(), *(matrix(got.column(c).combine_chunks()) for c in "st")
        known = spark.sparkContext.broadcast((qids, s, np.round((s * t).sum(axis=1), DIGITS)))
        counts = teachers.mapInArrow(_counted(known), "row long, n long").groupBy("row").agg(F.sum("n").alias("n"))
        names = spark.createDataFrame(pa.table({"row": np.arange(len(qids)), "id": qids}))
        out = out.unionByName(names.join(counts, "row", "left").select("id", (F.coalesce("n", F.lit(0)) + 1).alias("rank")))
    return out


def mrr(queries: DataFrame, pairs: DataFrame, id_col: str, student_col: str, teacher_col: str) -> DataFrame:
    """One row: the mean reciprocal rank of the query rows' own teachers among those of all rows, and n."""
    ranks = own_ranks(queries, pairs, id_col, student_col, teacher_col)
    return ranks.agg(F.round(F.avg(1.0 / F.col("rank")), 6).alias("mrr"), F.count(F.lit(1)).alias("n"))
