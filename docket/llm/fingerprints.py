"""Document fingerprints by consistent weighted sampling.

Terms are the words of a text (ASCII white space, A-Z lower-cased), weights their counts. Sample j
draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) per term and takes the term with the least
ln a = ln c - r (t - b) - r, where t = floor(ln w / r + b); the pair (term, t) is the sample. Two
texts share a sample with probability sum(min(w, v)) / sum(max(w, v)), their generalised Jaccard
similarity. Triples (r, c, b) come from one pool of 65,536 drawn from a fixed seed; a term and a
sample number choose their triple by multiply-shift hashing, so every task draws the same.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docket.llm.common import shuffle_parts, texts

SAMPLES = 128
SEED = 20240229
#: Word hashes that a worker remembers, and terms weighed at once.
REMEMBERED, AT_ONCE = 500_000, 2048


class Sampler:
    """Draws the samples of weighted terms."""

    def __init__(self, samples: int = SAMPLES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        pool = 1 << 16
        self.r = rng.gamma(2, 1, pool).astype(np.float32)
        self.ln_c = np.log(rng.gamma(2, 1, pool)).astype(np.float32)
        self.b = rng.random(pool, np.float32)
        self.one = self.ln_c + self.r * self.b - self.r  # ln a of weight 1, where t = 0
        self.mul = (rng.integers(0, 1 << 31, samples) * 2 + 1).astype(np.uint32)[:, None]
        self.add = rng.integers(0, 1 << 32, samples).astype(np.uint32)[:, None]
        self.samples, self.hashes = samples, {}

    def hash(self, term: bytes) -> int:
        from xxhash import xxh64_intdigest

        h = self.hashes.get(term)
        if h is None:
            h = xxh64_intdigest(term)
            if len(self.hashes) < REMEMBERED:
                self.hashes[term] = h
        return h

    def of_terms(self, weights: dict[bytes, float]) -> np.ndarray:
        """The samples as 16-bit numbers; 0 throughout where there are no terms."""
        if not weights:
            return np.zeros(self.samples, np.uint16)
        h = np.fromiter(map(self.hash, weights), np.uint64, len(weights))
        ln_w = np.log(np.fromiter(weights.values(), np.float32, len(weights)))
        order = np.argsort(h)  # so that a tie does not depend on the order of the words
        h, ln_w = h[order], ln_w[order]
        h32 = (h >> np.uint64(32)).astype(np.uint32)
        best = np.full(self.samples, np.inf, np.float32)
        which = np.zeros(self.samples, np.int64)
        for at in range(0, len(h), AT_ONCE):
            part = slice(at, at + AT_ONCE)
            pool = self.mul * h32[part]
            pool += self.add
            pool >>= np.uint32(16)
            pool = pool.astype(np.intp)
            ln_a = self.one.take(pool, mode="clip")
            more = np.flatnonzero(ln_w[part])
            if len(more):
                p = pool[:, more]
                r, b = self.r.take(p, mode="clip"), self.b.take(p, mode="clip")
                ln_a[:, more] = self.ln_c.take(p, mode="clip") - r * (np.floor(ln_w[part][more] / r + b) - b) - r
            k = ln_a.argmin(1)
            least = ln_a[np.arange(self.samples), k]
            better = least < best
            best[better], which[better] = least[better], k[better] + at
        p = (self.mul[:, 0] * h32[which] + self.add[:, 0]) >> np.uint32(16)
        t = np.floor(ln_w[which] / self.r[p] + self.b[p]).astype(np.int64).astype(np.uint64)
        mixed = (h[which] ^ (t * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        return np.maximum(mixed >> np.uint64(48), 1).astype(np.uint16)

    def of_text(self, text: str) -> np.ndarray:
        return self.of_terms(Counter(text.encode("utf-8", "surrogatepass").lower().split()))


@lru_cache(maxsize=2)
def sampler(samples: int) -> Sampler:
    return Sampler(samples)


def as_string(samples: np.ndarray) -> str:
    return base64.b64encode(samples.astype("<u2").tobytes()).decode()


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """Share of equal samples: the estimate of generalised Jaccard similarity."""
    return float((one == other).mean())


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(doc_id, fingerprint) of every row; null and empty texts have the fingerprint of no terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = sampler(samples)
        for batch in batches:
            prints = [as_string(draw.of_text(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string")


def _with_next(docs: DataFrame) -> DataFrame:
    """Rows dealt to runs of ascending ids, each run followed by a copy (``guest``) of the first row
    of the next one (after the last run: of the first), sorted. Nothing else is sent twice.

    The runs' borders are quantiles of the ids; borders and first ids, one each per run, are all
    that is gathered.
    """
    spark = docs.sparkSession
    n = shuffle_parts(spark)
    rows = docs.withColumn("place", F.coalesce("doc_id", F.lit(-(1 << 63))))
    spread = [i / n for i in range(1, n)]
    borders = rows.agg(F.percentile_approx(F.col("place").cast("double"), spread or [0.5], 10_000)).head()[0] or [0.0]
    runs = Bucketizer(splits=[-float("inf"), *sorted(set(borders)), float("inf")], inputCol="_place", outputCol="_run")
    rows = runs.transform(rows.withColumn("_place", F.col("place").cast("double"))).select(
        "doc_id", "text", "place", F.col("_run").cast("int").alias("run"))
    firsts = rows.groupBy("run").agg(F.min("place").alias("place")).orderBy("run").collect()  # a row per run
    hosts = [(r.place, firsts[i - 1].run) for i, r in enumerate(firsts)]  # the run before; before the first: the last
    host = F.broadcast(spark.createDataFrame(hosts or [(0, 0)], "place long, host int"))
    copies = F.filter(F.array(F.struct(F.col("run"), F.lit(False).alias("guest")),
                              F.struct(F.col("host").alias("run"), F.lit(True).alias("guest"))), lambda x: x.run.isNotNull())
    sent = rows.join(host, "place", "left").select("doc_id", "text", "place", F.explode(copies).alias("to"))
    return (sent.select("doc_id", "text", "place", "to.run", "to.guest")
            .repartitionById(n, "run").sortWithinPartitions("run", "guest", "place", "text").drop("place"))


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next document in ascending id; after the last comes the first. A single document
    is its own next one. Null text counts as empty, null ids come first, equal ids are ordered by
    text. Texts without words are like each other (1) and unlike all others (0).
    """
    import hashlib

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw, held = sampler(samples), None
        for batch in batches:
            out = []
            for doc, text, at, guest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "run", "guest")), strict=True):
                if guest and held is None:
                    continue  # a further row of the guest's id
                prints = draw.of_text(text)
                if held is not None:
                    own, own_text, own_prints, own_run = held
                    if own_run != at:
                        raise ValueError("a run of documents without the next one's first row")
                    half = len(own_text) // 2
                    edited = own_text[: len(own_text) - half] + text[:half]
                    edited_prints = own_prints if edited == own_text else draw.of_text(edited)
                    out.append((own, len(own_text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                                as_string(own_prints), as_string(edited_prints), likeness(own_prints, edited_prints),
                                likeness(own_prints, prints)))
                held = None if guest else (doc, text, prints, at)
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return _with_next(texts(docs, id_col, text_col)).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
