"""Code-book decoding and dictionary lookups as joins.

Nothing is marked for broadcast here: the fixed books come marked from
``docket.functions.codebooks.book_df``, and any other DataFrame is left to
AQE's size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_SPECIFIED = "Not specified"


def code_of(value: Column) -> Column:
    """``int(float(value))`` or NULL when that would fail (NaN, text, inf)."""
    d = value.cast("string").try_cast("double")
    ok = d.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(2.0e9))
    return F.when(ok, d.cast("int"))


def decode_codes(df: DataFrame, col: str, book: DataFrame, default: str, out: str) -> DataFrame:
    """Add ``out`` = label of ``col`` in ``book`` (code int, label string).

    NULL → 'Not specified'; not castable or not in the book → ``default``.
    """
    key = f"__code_{out}"
    b = book.select(F.col("code").alias(key), F.col("label").alias(f"__label_{out}"))
    j = df.withColumn(key, code_of(F.col(col))).join(b, key, "left")
    label = (F.when(F.col(col).isNull(), F.lit(NOT_SPECIFIED))
             .otherwise(F.coalesce(F.col(f"__label_{out}"), F.lit(default))))
    return j.withColumn(out, label).drop(key, f"__label_{out}")


def lookup(df: DataFrame, col: str, book: DataFrame, key: str, value: str, out: str,
           pass_through: bool = True) -> DataFrame:
    """Dictionary lookup ``out = book[col]``; unknown keys pass through."""
    b = book.select(F.col(key).alias(f"__k_{out}"), F.col(value).alias(f"__v_{out}"))
    j = df.join(b, F.col(col) == F.col(f"__k_{out}"), "left")
    res = F.coalesce(F.col(f"__v_{out}"), F.col(col)) if pass_through else F.col(f"__v_{out}")
    return j.withColumn(out, res).drop(f"__k_{out}", f"__v_{out}")


def name_code_map(df: DataFrame, col: str, book: DataFrame, out: str = "name") -> DataFrame:
    """Member code → canonical name, unknown codes pass through.  The book
    grows with the member table, so no broadcast mark: AQE decides by size."""
    return lookup(df, col, book, "code", "name", out)


def state_name_map(df: DataFrame, col: str, book: DataFrame, out: str = "state_full") -> DataFrame:
    """Abbreviation → full name; unknown passes through; '' / NULL → ''."""
    j = lookup(df, col, book, "abbr", "name", out)
    return j.withColumn(out, F.when(F.coalesce(F.col(col), F.lit("")) == "", F.lit("")).otherwise(F.col(out)))


def url_correction(df: DataFrame, name_col: str, url_col: str, book: DataFrame, prefix: str,
                   out: str = "url") -> DataFrame:
    """Override the URL for listed names (``prefix + title``), else keep."""
    b = book.select(F.col("name").alias("__n"), F.col("title").alias("__t"))
    j = df.join(b, F.col(name_col) == F.col("__n"), "left")
    return j.withColumn(out, F.when(F.col("__t").isNotNull(), F.concat(F.lit(prefix), F.col("__t")))
                        .otherwise(F.col(url_col))).drop("__n", "__t")


def parse_share_sentinel(s: Column) -> Column:
    """'' or '-1' (or NULL) → −1.0; otherwise the float value."""
    return F.when(s.isNull() | (s == "") | (s == "-1"), F.lit(-1.0)).otherwise(s.try_cast("double"))
