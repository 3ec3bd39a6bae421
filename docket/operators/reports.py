"""Aggregate reports: one ``agg`` each, partial aggregation
map-side, so a hot key or a huge table costs one small shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def r6(c: Column) -> Column:
    return F.round(c, 6)


def case_summary_stats(cases: DataFrame) -> DataFrame:
    """Mean shares over valid cases, valid/invalid counts, unanimous and
    no-absence counts, distinct chiefs, first/last year prefix."""
    valid = F.col("pct_in_favor") != -1
    return cases.agg(
        r6(F.avg(F.when(valid, F.col("pct_in_favor")))).alias("avg_in_favor"),
        r6(F.avg(F.when(valid, F.col("pct_against")))).alias("avg_against"),
        r6(F.avg(F.when(valid, F.col("pct_absent")))).alias("avg_absent"),
        F.count_if(valid).alias("n_valid"),
        F.count_if(~valid).alias("n_invalid"),
        F.count_if(valid & (F.col("pct_in_favor") == 1.0)).alias("n_unanimous"),
        F.count_if(valid & (F.col("pct_absent") == 0.0)).alias("n_no_absent"),
        F.countDistinct("chief").alias("n_chiefs"),
        F.min(F.substring("caseIssuesId", 1, 4)).alias("first_year"),
        F.max(F.substring("caseIssuesId", 1, 4)).alias("last_year"),
    )


def expected_count(df: DataFrame, col: str) -> DataFrame:
    """``nunique`` (NULL excluded) next to the distinct-rows count (NULL is
    one value) — the two counts the original mixes."""
    return df.agg(F.countDistinct(col).alias("n_unique"),
                  (F.countDistinct(col) + F.max(F.when(F.col(col).isNull(), 1).otherwise(0)))
                  .alias("n_distinct_rows"))


def completeness_gate(expected: Column, found: Column, tolerance: int = 150) -> Column:
    """Complete iff something was found and at most ``tolerance`` are
    missing; with nothing expected any found count passes."""
    return (found > 0) & ((expected <= 0) | ((expected - found) <= tolerance))


def coverage(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """One row per artefact: found, total, percent, missing."""
    aggs = [F.count(F.lit(1)).alias("__total")] + [F.count_if(c).alias(k) for k, c in flags.items()]
    wide = df.agg(*aggs)
    stack = F.explode(F.array(*[F.struct(F.lit(k).alias("artefact"), F.col(k).alias("found")) for k in flags]))
    return (wide.select("__total", stack.alias("s"))
            .select("s.artefact", "s.found", F.col("__total").alias("total"),
                    r6(F.when(F.col("__total") > 0, F.col("s.found") * 100.0 / F.col("__total"))).alias("pct"),
                    (F.col("__total") - F.col("s.found")).alias("missing")))


def unique_references(records: DataFrame) -> DataFrame:
    """Distinct bio and description references over the nested arrays, and
    reference totals — one pass over the records, one aggregate."""
    # a record's references side by side, so that the records are worked out once
    bios = F.transform(F.coalesce("bios", F.array().cast("array<string>")), lambda b: F.struct(F.lit("bio").alias("kind"), b.alias("ref")))
    own = F.array(F.struct(F.lit("desc").alias("kind"), F.col("description").alias("ref")))
    refs = records.select(F.explode(F.concat(own, bios)).alias("r")).select("r.kind", "r.ref")

    def of(kind):
        return F.when(F.col("kind") == kind, F.col("ref"))

    return refs.agg(F.countDistinct(of("bio")).alias("n_unique_bios"), F.count(of("bio")).alias("total_bio_refs"),
                    F.countDistinct(of("desc")).alias("n_unique_descriptions"),
                    F.count(of("desc")).alias("total_description_refs"))


def year_histogram(df: DataFrame, year_col: str = "year") -> DataFrame:
    return df.groupBy(year_col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col(year_col).desc())


def year_span(df: DataFrame, group_cols: Sequence[str], year_col: str = "year") -> DataFrame:
    """``min-max`` of the positive years per group, ``N/A`` when none."""
    y = F.when(F.col(year_col) > 0, F.col(year_col))
    return df.groupBy(*group_cols).agg(
        F.coalesce(F.concat_ws("-", F.min(y).cast("string"), F.max(y).cast("string")), F.lit("N/A")).alias("span"),
        F.count(F.lit(1)).alias("n"))


def text_reduction_stats(stats: DataFrame) -> DataFrame:
    """Totals over per-document cleaning stats."""
    return stats.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("original_words").alias("words_before"), F.sum("processed_words").alias("words_after"),
        F.sum("original_chars").alias("chars_before"), F.sum("processed_chars").alias("chars_after"),
        F.count_if("truncated").alias("n_truncated"), F.count_if("intro_removed").alias("n_intro_removed"),
        F.count_if("section_cut").alias("n_section_cut"),
    ).withColumn("pct_word_reduction",
                 r6(F.when(F.col("words_before") > 0,
                           (F.col("words_before") - F.col("words_after")) * 100.0 / F.col("words_before"))))


def status_report(df: DataFrame, status_col: str = "status") -> DataFrame:
    """Counts per status and their share of all rows."""
    from pyspark.sql.window import Window
    per = df.groupBy(status_col).agg(F.count(F.lit(1)).alias("n"))
    # the window spans the handful of status rows only
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return per.withColumn("rate", r6(F.col("n") / total))
