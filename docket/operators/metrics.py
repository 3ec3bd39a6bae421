"""Classification metrics, loss reductions and trial/epoch-log analytics
(SURVEY §2.4-2.6).  Aggregates are single passes with partial aggregation;
running values over epoch logs are windows partitioned by run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def confusion_matrix(df: DataFrame, true_col: str, pred_col: str, num_classes: int = 3) -> DataFrame:
    """One row per class 0..n−1 (and per further truth label that occurs):
    counts per predicted class and of all other predictions, null included."""
    t, p = F.col(true_col), F.col(pred_col)
    classes = list(range(num_classes))
    counted = df.groupBy(t.cast("int").alias("true_class")).agg(
        *[F.count_if(p == c).alias(f"pred_{c}") for c in classes],
        F.count_if(~F.coalesce(p.isin(classes), F.lit(False))).alias("pred_other"))
    grid = df.sparkSession.range(num_classes).select(F.col("id").cast("int").alias("true_class"))
    return grid.join(counted, "true_class", "full").na.fill(0, [c for c in counted.columns if c != "true_class"])


def combined_metric(scored: DataFrame, batch_col: str, kl_col: str, true_col: str, pred_col: str,
                    num_classes: int = 3) -> DataFrame:
    """(KL + 1 − F1) / 2 over one scored frame: KL as the mean of batch means
    over the rows where it is defined, F1 unrounded; the row count and the
    count of rows without a KL beside them."""
    batches = scored.groupBy(batch_col).agg(F.avg(kl_col).alias("__m"))
    kl = batches.agg(F.avg("__m").alias("kl"))
    f1 = _f1_columns(scored, true_col, pred_col, num_classes)
    n = scored.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(kl_col).isNull()).alias("n_undefined"))
    one = F.lit(1).alias("__one")
    j = kl.select("*", one).join(f1.select(F.col("__macro").alias("f1"), one), "__one").join(n.select("*", one), "__one")
    return j.select(F.round((F.col("kl") + 1 - F.col("f1")) / 2, 6).alias("combined"), F.round("kl", 6).alias("kl"),
                    F.round("f1", 6).alias("f1"), "n", "n_undefined")


def _f1_columns(df: DataFrame, true_col: str, pred_col: str, num_classes: int) -> DataFrame:
    """One row: unrounded F1 of each class (``__f<c>``) and their mean (``__macro``)."""
    t, p = F.col(true_col), F.col(pred_col)
    aggs = []
    for c in range(num_classes):
        aggs += [F.count_if((t == c) & (p == c)).alias(f"tp{c}"), F.count_if(t == c).alias(f"t{c}"),
                 F.count_if(p == c).alias(f"p{c}")]
    counts = df.agg(*aggs)

    def f1(c: int) -> Column:
        tp, tc, pc = F.col(f"tp{c}"), F.col(f"t{c}"), F.col(f"p{c}")
        return (F.when((tc == 0) & (pc == 0), F.lit(1.0)).when((tc == 0) | (pc == 0), F.lit(0.0))
                .otherwise(2.0 * tp / (tc + pc)))

    per = counts.select(*[f1(c).alias(f"__f{c}") for c in range(num_classes)])
    total = F.col("__f0")
    for c in range(1, num_classes):
        total = total + F.col(f"__f{c}")
    return per.withColumn("__macro", total / num_classes)


def f1_macro(df: DataFrame, true_col: str, pred_col: str, num_classes: int = 3) -> DataFrame:
    """Unweighted mean of per-class F1 over all ``num_classes`` classes:
    both sides empty → 1.0, one side empty → 0.0, else 2·tp/(t+p)."""
    f1 = _f1_columns(df, true_col, pred_col, num_classes)
    return f1.select(*[F.round(f"__f{c}", 6).alias(f"f1_{c}") for c in range(num_classes)],
                     F.round("__macro", 6).alias("f1_macro"))


def mean_of_batch_means(df: DataFrame, batch_col: str, value_col: str) -> DataFrame:
    """Average of per-batch means (a short last batch weighs as much as a
    full one), plus the number of batches."""
    per = df.groupBy(batch_col).agg(F.avg(value_col).alias("__m"))
    return per.agg(F.round(F.avg("__m"), 6).alias("loss"), F.count(F.lit(1)).alias("n_batches"))


def cv_fold_mean(folds: DataFrame, trial_col: str, metric_col: str, completed: Column,
                 default: float = 10.0) -> DataFrame:
    """Mean metric over completed folds per trial; ``default`` when a trial
    has none (10.0 in the main tuner, 0.0 in pretraining)."""
    return folds.groupBy(trial_col).agg(
        F.round(F.coalesce(F.avg(F.when(completed, F.col(metric_col))), F.lit(default)), 6).alias("cv_mean"),
        F.count_if(completed).alias("n_completed"))


def trial_summary(trials: DataFrame, state_col: str, value_col: str, trial_col: str) -> DataFrame:
    """Trials per state with the best (lowest) trial and value of each."""
    return trials.groupBy(state_col).agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(F.col(trial_col), F.struct(F.col(value_col), F.col(trial_col))).alias("best_trial"),
        F.round(F.min(value_col), 6).alias("best_value"))


def best_trial(trials: DataFrame, trial_col: str, value_col: str, minimize: bool = True) -> DataFrame:
    """Argmin (or argmax) trial, ties to the lowest trial id."""
    key = F.struct(F.col(value_col) if minimize else -F.col(value_col), F.col(trial_col))
    return trials.agg(F.min_by(F.struct(trial_col, value_col), key).alias("b")) \
        .select(F.col(f"b.{trial_col}").alias(trial_col), F.round(F.col(f"b.{value_col}"), 6).alias(value_col))


def early_stop(log: DataFrame, run_cols: Sequence[str], epoch_col: str, value_col: str, patience: int,
               only_even: bool = False, min_epochs: int = 0, chunk_rows: int = 1 << 20) -> DataFrame:
    """Per run: best value, the epoch it was reached and the stop epoch.

    An epoch improves when its value is strictly below every earlier counted
    value.  The run stops at the first counted epoch whose count of counted
    epochs since the last improvement reaches ``patience`` (and, when
    ``only_even``, whose epoch ≥ ``min_epochs``); otherwise at its last epoch,
    counted or not.  ``only_even`` counts even 0-based epochs only (the tuner
    variant).

    Runs are cut into chunks of ``chunk_rows`` by a distributed rank, so one
    huge run is spread over many tasks.  Running values are windows within a
    chunk; what earlier chunks of the run add (least value, epochs counted,
    last improvement) is a scan over the run's chunk totals, a few rows.
    """
    from docket.operators.splits import global_rank

    run = list(run_cols)
    ends = log.groupBy(*run).agg(F.max(epoch_col).alias("__last"))
    counted = F.col(epoch_col) % 2 == 0 if only_even else F.lit(True)
    ranked = global_rank(log.filter(counted).select(*run, F.col(epoch_col).alias("__e"), F.col(value_col).alias("__v")),
                         [*[F.col(c).asc() for c in run], F.col("__e").asc()], "__g")
    chunked = ranked.withColumn("__chunk", F.floor((F.col("__g") - 1) / chunk_rows)).drop("__g")
    inner = Window.partitionBy(*run, "__chunk").orderBy("__e")
    before = Window.partitionBy(*run).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)

    totals = chunked.groupBy(*run, "__chunk").agg(F.min("__v").alias("__m"), F.count(F.lit(1)).alias("__n"))
    earlier = totals.select(*run, "__chunk", F.min("__m").over(before).alias("__m0"),
                            F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"))
    prev = F.least("__m0", F.min("__v").over(inner.rowsBetween(Window.unboundedPreceding, -1)))
    rows = chunked.join(earlier, [*run, "__chunk"]).withColumn("__prev", prev).withColumn(
        "__k", F.col("__n0") + F.row_number().over(inner)).withColumn(
        "__imp", F.col("__prev").isNull() | (F.col("__v") < F.col("__prev")))
    # of each row: its number and the last improvement within the chunk; of each chunk: its last improvement
    local = F.max(F.when(F.col("__imp"), F.col("__k"))).over(inner.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__lk", local).select(*run, "__chunk", "__e", "__v", "__k", "__imp", "__lk").checkpoint()
    lasts = rows.groupBy(*run, "__chunk").agg(F.max("__lk").alias("__l"))
    lasts = lasts.select(*run, "__chunk", F.max("__l").over(before).alias("__l0"))
    rows = rows.join(lasts, [*run, "__chunk"])
    idle = F.col("__k") - F.greatest("__l0", "__lk")
    stop = F.when((idle >= patience) & (F.col("__e") >= min_epochs), F.col("__e"))
    # the best epoch is the last improvement before the stop: no improvement lies between it and the
    # first stop, so among rows up to the first stop it is the row of the least value
    firsts = rows.groupBy(*run).agg(F.min(stop).alias("__fs"))
    joined = rows.filter("__imp").join(firsts, run).filter(F.col("__fs").isNull() | (F.col("__e") <= F.col("__fs")))
    best = joined.groupBy(*run).agg(F.max("__e").alias("best_epoch"), F.max_by("__v", "__e").alias("__bv"), F.first("__fs").alias("__fs"))
    return best.join(ends, run).select(
        *run, F.coalesce("__fs", "__last").alias("stop_epoch"), "best_epoch", F.round("__bv", 6).alias("best_value"),
        F.col("__fs").isNotNull().alias("stopped"))
