"""Set operations on key tables: anti/semi joins and unions,
one shuffle on the key each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending_work(required: DataFrame, done: DataFrame, on_disk: DataFrame, key: str,
                 force: bool = False) -> DataFrame:
    """required − done (all of required when forced), split into keys whose
    source exists (``existing``) and keys missing on disk (``missing``)."""
    req = required.select(key).distinct()
    todo = req if force else req.join(done.select(key).distinct(), key, "left_anti")
    have = on_disk.select(F.col(key).alias("__k")).distinct().withColumn("__have", F.lit(True))
    j = todo.join(have, F.col(key) == F.col("__k"), "left")
    return j.select(key, F.when(F.col("__have"), F.lit("existing")).otherwise(F.lit("missing")).alias("status"))


def coverage_intersection(required: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """|required ∩ done|, |required| and their ratio, in one aggregate."""
    req = required.select(key).distinct()
    d = done.select(F.col(key).alias("__d")).distinct().withColumn("__hit", F.lit(1))
    j = req.join(d, F.col(key) == F.col("__d"), "left")
    return j.agg(F.count(F.lit(1)).alias("n_required"), F.count("__hit").alias("n_done")) \
        .withColumn("coverage", F.round(F.col("n_done").cast("double") / F.col("n_required"), 6))


def overlap_count(a: DataFrame, b: DataFrame) -> DataFrame:
    """|a ∩ b| (expected 0 for train vs holdout)."""
    return a.intersect(b).agg(F.count(F.lit(1)).alias("n_overlap"))


def upsert_new_wins(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Existing ∪ new by key, the new row overriding; idempotent.  Done as an
    anti join + union (no window), so re-applying the same increment gives
    the same table.  Null keys are equal to each other."""
    same = new.select(*[F.col(k).alias(f"__{k}") for k in keys])
    old_only = existing.join(same, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left_anti")
    return new.withColumn("src", F.lit("new")).unionByName(old_only.withColumn("src", F.lit("old")))
