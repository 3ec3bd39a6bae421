"""Row filters and gates.  All are narrow (no shuffle) except
the existence checks, which are semi joins against a key table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket.functions import strings as S
from docket.operators.records import DESC_DIR


def filter_has_description(records: DataFrame, desc_keys: DataFrame, key_col: str = "file_key") -> DataFrame:
    """Keep records whose description path is non-blank and resolves to a
    file in the description store (semi join on the path's stem)."""
    stem = F.regexp_replace(F.replace(F.col("description"), F.lit(DESC_DIR), F.lit("")), r"\.txt$", "")
    keys = desc_keys.select(F.col(key_col).alias("__k"))
    nonblank = F.col("description").isNotNull() & (S.strip(F.col("description")) != "")
    return (records.filter(nonblank).withColumn("__stem", stem)
            .join(keys, F.col("__stem") == F.col("__k"), "left_semi").drop("__stem"))


def filter_year_range(df: DataFrame, year_col: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Inclusive range, either bound optional (pushed into the scan when the
    year is a stored column)."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col(year_col) >= start)
    if end is not None:
        cond = cond & (F.col(year_col) <= end)
    return df.filter(cond)


def split_valid(cases: DataFrame, share_col: str = "pct_in_favor") -> DataFrame:
    """Flag rows that carry real shares (the −1 sentinel marks unclear)."""
    return cases.withColumn("valid", F.col(share_col) != -1)


def filter_valid_cases(cases: DataFrame, share_col: str = "pct_in_favor") -> DataFrame:
    return cases.filter(F.col(share_col) != -1)


def length_gate(raw: Column, filtered: Column, raw_min: int = 500, filtered_min: int = 50) -> Column:
    """Fetch outcome per row: no content / too short raw → 'no_content';
    filter failed or too short → 'api_failed'; else 'success'."""
    return (F.when(raw.isNull() | (raw == "") | (F.length(raw) < raw_min), F.lit("no_content"))
            .when(filtered.isNull() | (filtered == "") | (F.length(filtered) < filtered_min), F.lit("api_failed"))
            .otherwise(F.lit("success")))


def max_words_gate(docs: DataFrame, text_col: str = "text", max_words: int = 10000) -> DataFrame:
    """Adds ``words`` and ``skipped`` (more than ``max_words`` words)."""
    return docs.withColumn("words", S.word_count(F.col(text_col))) \
        .withColumn("skipped", F.col("words") > max_words)


# Header terms removed by the ablation.
ABLATE_TERMS = ["Justice", "State", "Position", "Appointment", "Nominated", "Birth",
                "Birth Year", "Appointment Date", "Nominated By"]


def ablate_lines(text: Column, terms: Iterable[str] = ABLATE_TERMS) -> Column:
    """Drop blank lines and lines starting ``term:``; rejoin with newlines."""
    prefixes = [t + ":" for t in terms]

    def keep(line: Column) -> Column:
        ok = S.strip(line) != ""
        for p in prefixes:
            ok = ok & ~line.startswith(p)
        return ok

    return F.array_join(F.filter(F.split(text, r"\r\n|\r|\n"), keep), "\n")
