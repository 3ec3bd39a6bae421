"""Ordered splits, holdout and cross-validation folds.

Everything here needs a position in a total order ("the n-th oldest case").
``global_rank`` gives that position without a single-partition window: the
rows are range-partitioned on the (unique) order key, sorted inside each
partition, counted per partition, and each row's rank is its partition's
offset plus its position inside the partition.  A year that holds a third
of all rows is split across many range partitions because the ordinal
breaks the ties.  Scalars such as "n" or "earliest holdout year" are scalar
subqueries (``DataFrame.scalar()``), never driver round trips or cross joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docket.session import checkpoint_dir


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def global_rank(df: DataFrame, order: Sequence[Column], rank_col: str = "rn") -> DataFrame:
    """Add a 1-based rank in ``order`` (which must be a total order).

    The range-partitioned, position-tagged rows are written once with a
    reliable ``checkpoint()`` (shared checkpoint folder): the per-partition
    counts and the rows must come from the same partitioning, and a
    recomputation after an executor loss could sample different range
    bounds when the input is itself a shuffle output.
    """
    checkpoint_dir(df.sparkSession)
    s = df.repartitionByRange(_parts(df), *order).sortWithinPartitions(*order)
    s = (s.withColumn("__pid", F.spark_partition_id())
         .withColumn("__pos", F.monotonically_increasing_id() - F.col("__pid").cast("long") * F.lit(1 << 33)))
    s = s.checkpoint(eager=True)
    counts = s.groupBy("__pid").agg(F.count(F.lit(1)).alias("__c"))
    # at most spark.sql.shuffle.partitions rows: a bounded broadcast
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__off"))
    return (s.join(F.broadcast(offsets), "__pid")
            .withColumn(rank_col, F.col("__off") + F.col("__pos") + 1)
            .drop("__pid", "__pos", "__off"))


def count_of(df: DataFrame) -> Column:
    """Row count as a scalar-subquery column."""
    return df.agg(F.count(F.lit(1))).scalar()


def holdout_most_recent(cases: DataFrame, year_col: str, ord_col: str, p: float = 0.15) -> DataFrame:
    """Newest ``floor(n·p)`` cases (year desc, ties by ordinal), with their
    rank ``rn``.  A histogram of the years says which can reach the
    threshold; only their rows are ranked."""
    years = cases.groupBy(F.col(year_col).alias("__y")).agg(F.count(F.lit(1)).alias("__n"))
    newer = Window.orderBy(F.col("__y").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row per year
    hist = years.select("__y", F.coalesce(F.sum("__n").over(newer), F.lit(0)).alias("__before"))
    k = F.floor(years.agg(F.sum("__n")).scalar() * F.lit(float(p)))
    near = cases.join(hist, F.col(year_col).eqNullSafe(F.col("__y"))).filter(F.col("__before") < k).drop("__y", "__before")
    # all rows of the newest years: their rank among themselves is the rank among all
    return global_rank(near, [F.col(year_col).desc(), F.col(ord_col).asc()]).filter(F.col("rn") <= k)


def year_ranks(df: DataFrame, year_col: str, ord_col: str) -> DataFrame:
    """``rn_asc`` (year, then ordinal) and ``rn_desc`` (year descending, ties
    still by rising ordinal).  One rank: the descending one follows from it
    and the number of rows per year."""
    ranked = global_rank(df, [F.col(year_col).asc(), F.col(ord_col).asc()], "rn_asc")
    per = ranked.groupBy(F.col(year_col).alias("__y")).agg(F.min("rn_asc").alias("__first"), F.count(F.lit(1)).alias("__n"))
    n = per.agg(F.sum("__n")).scalar()
    later = n - (F.col("__first") - 1) - F.col("__n")
    return (ranked.join(per, F.col(year_col).eqNullSafe(F.col("__y")))
            .withColumn("rn_desc", later + F.col("rn_asc") - F.col("__first") + 1).drop("__y", "__first", "__n"))


def split_time_train_val(dataset: DataFrame, holdout: DataFrame, key: str, year_col: str, ord_col: str,
                         train_ratio: float = 0.85, val_ratio: float = 0.15) -> DataFrame:
    """Exclude the holdout, keep years strictly before the earliest (positive)
    holdout year, then the oldest ``int(n·share)`` rows train, rest val."""
    hk = holdout.select(F.col(key).alias("__hk"), F.col(year_col).alias("__hy"))
    earliest = hk.agg(F.min(F.when(F.col("__hy") > 0, F.col("__hy")))).scalar()
    avail = dataset.join(hk.select("__hk"), F.col(key) == F.col("__hk"), "left_anti")
    pre = avail.filter(earliest.isNull() | (F.col(year_col) < earliest))
    total = train_ratio + val_ratio
    share = train_ratio / (total if total > 0 else 1.0)
    ranked = global_rank(pre, [F.col(year_col).asc(), F.col(ord_col).asc()])
    n_train = F.floor(count_of(ranked) * F.lit(share))
    return ranked.withColumn("role", F.when(F.col("rn") <= n_train, F.lit("train")).otherwise(F.lit("val")))


def split_time_ratios(df: DataFrame, year_col: str, ord_col: str, train: float = 0.70,
                      val: float = 0.15) -> DataFrame:
    """Chronological ``int(.7n)`` train, ``int(.15n)`` val, remainder test."""
    ranked = global_rank(df, [F.col(year_col).asc(), F.col(ord_col).asc()])
    n = count_of(ranked)
    n_train = F.floor(n * F.lit(train))
    n_val = F.floor(n * F.lit(val))
    role = (F.when(F.col("rn") <= n_train, F.lit("train"))
            .when(F.col("rn") <= n_train + n_val, F.lit("val")).otherwise(F.lit("test")))
    return ranked.withColumn("role", role)


def split_tail_counts(df: DataFrame, year_col: str, ord_col: str, test_size: int, val_size: int) -> DataFrame:
    """Ordered by year (NULL → 0): last ``test_size`` test, the ``val_size``
    before them val, the rest train."""
    y = F.coalesce(F.col(year_col), F.lit(0))
    ranked = global_rank(df.withColumn("__y", y), [F.col("__y").asc(), F.col(ord_col).asc()]).drop("__y")
    from_end = count_of(ranked) - F.col("rn") + 1
    role = (F.when(from_end <= test_size, F.lit("test"))
            .when(from_end <= test_size + val_size, F.lit("val")).otherwise(F.lit("train")))
    return ranked.withColumn("role", role)


def hash_order(key: Column, seed: int) -> Column:
    """Partition-independent pseudo-random order key from md5(key|seed)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10) \
        .cast("long")


def split_random(df: DataFrame, key: str, seed: int = 42, train_ratio: float = 0.85) -> DataFrame:
    """Seeded shuffle (md5 order, ties by key); first ``int(n·r)`` train."""
    ranked = global_rank(df.withColumn("__h", hash_order(F.col(key), seed)),
                         [F.col("__h").asc(), F.col(key).asc()]).drop("__h")
    n_train = F.floor(count_of(ranked) * F.lit(train_ratio))
    return ranked.withColumn("role", F.when(F.col("rn") <= n_train, F.lit("train")).otherwise(F.lit("val")))


def cv_forward_folds(df: DataFrame, year_col: str, ord_col: str, train_size: int | float, val_size: int | float,
                     n_folds: int) -> DataFrame:
    """Oldest first, disjoint blocks of ``train_size + val_size`` rows (or
    shares of all rows, where given as fractions); fold i starts at i·(T+V).
    A fold that does not fit is dropped with all later ones.  Every row is in
    at most one fold."""
    ranked = global_rank(df, [F.col(year_col).asc(), F.col(ord_col).asc()])
    n = count_of(ranked)

    def rows(size: int | float) -> Column:
        return F.floor(n * F.lit(size)) if isinstance(size, float) else F.lit(size)

    train, size = rows(train_size), rows(train_size) + rows(val_size)
    full = F.least(F.lit(n_folds), F.coalesce(F.floor(n / size), F.lit(0)))
    r0 = F.col("rn") - 1
    return (ranked.withColumn("fold", F.floor(r0 / size).cast("int"))
            .filter(F.col("fold") < full)
            .withColumn("role", F.when(r0 % size < train, F.lit("train")).otherwise(F.lit("val"))))


def cv_backward_folds(df: DataFrame, year_col: str, ord_col: str, test_size: int, train_size: int,
                      val_size: int, n_folds: int, fallback_val: int) -> DataFrame:
    """Folds carved backwards from before the test tail: fold i validates on
    ``[usable−(i+1)V, usable−iV)`` (clipped at 0) and trains on the T rows
    before that (clipped).  Folds stop at the first empty window.  Train
    windows overlap, so a row may appear in several folds: each row is
    expanded over the (bounded) fold numbers and filtered.  Without any fold
    the single fallback split is returned as fold 0."""
    y = F.coalesce(F.col(year_col), F.lit(0))
    ranked = global_rank(df.withColumn("__y", y), [F.col("__y").asc(), F.col(ord_col).asc()]).drop("__y")
    n = count_of(ranked)
    usable = F.greatest(n - F.lit(test_size), F.lit(0)) if test_size > 0 else n
    r0 = F.col("rn") - 1

    def bounds(i: Column):
        val_end = usable - i * val_size
        val_start = F.greatest(F.lit(0), val_end - val_size)
        train_end = val_start
        train_start = F.greatest(F.lit(0), train_end - train_size)
        return val_start, val_end, train_start, train_end

    # first fold index whose windows are empty; folds before it are valid
    i = F.col("fold")
    vs, ve, ts, te = bounds(i)
    bad = (ts >= te) | (vs >= ve)
    folds = df.sparkSession.range(n_folds).select(F.col("id").cast("int").alias("fold"))
    stop = folds.agg(F.min(F.when(bad, F.col("fold")))).scalar()
    n_valid = F.coalesce(stop, F.lit(n_folds))

    expanded = ranked.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    vs, ve, ts, te = bounds(F.col("fold"))
    role = (F.when((r0 >= vs) & (r0 < ve), F.lit("val"))
            .when((r0 >= ts) & (r0 < te), F.lit("train")))
    folded = expanded.withColumn("role", role).filter((F.col("fold") < n_valid) & F.col("role").isNotNull())

    fb_role = (F.when((r0 >= usable - fallback_val) & (r0 < usable), F.lit("val"))
               .when(r0 < usable - fallback_val, F.lit("train")))
    fallback = (ranked.withColumn("fold", F.lit(0)).withColumn("role", fb_role)
                .filter((n_valid == 0) & F.col("role").isNotNull()))
    return folded.unionByName(fallback)


def fold_cycle(trials: DataFrame, trial_col: str, n_folds: int) -> DataFrame:
    """Trial ``t`` uses fold ``t mod k``."""
    return trials.withColumn("fold", F.pmod(F.col(trial_col), F.lit(n_folds)).cast("int"))


def batch_ids(df: DataFrame, order: Sequence[Column], batch_size: int) -> DataFrame:
    """Consecutive batches of ``batch_size`` in ``order``."""
    return global_rank(df, order).withColumn("batch", F.floor((F.col("rn") - 1) / batch_size).cast("long"))
