"""Record layouts from semi-structured inputs: scraped table-row cells and
3-/4-element JSON training records (SURVEY §2.1, §2.9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docket.functions import strings as S

ARTICLE_HOST = "https://en.wikipedia.org"


def cells_to_record(rows: DataFrame, cells_col: str = "cells") -> DataFrame:
    """Table-row cells → typed member record.  Rows with fewer than 7 cells
    or without a link in the name cell are skipped.  The name cell holds
    ``text<TAB>href<TAB>small``; the appointment cell's first line is the
    date and its second (quotes/parentheses stripped) the method."""
    c = F.col(cells_col)

    def cell(i):
        return F.try_element_at(c, F.lit(i + 1))

    name_parts = F.split(cell(2), "\t")
    appt_lines = F.split(cell(6), "\n")
    n = F.size(c)
    tenure = S.split_tenure(F.when(n > 7, cell(7)).otherwise(F.lit("")))
    out = rows.filter((n >= 7) & (F.coalesce(F.try_element_at(name_parts, F.lit(2)), F.lit("")) != ""))
    return out.select(
        S.strip(F.try_element_at(name_parts, F.lit(1))).alias("name"),
        F.concat(F.lit(ARTICLE_HOST), F.try_element_at(name_parts, F.lit(2))).alias("url"),
        S.strip(F.coalesce(F.try_element_at(name_parts, F.lit(3)), F.lit(""))).alias("birth_death"),
        S.strip(cell(3)).alias("state"),
        F.when(cell(4).contains("Chief"), F.lit("Chief Justice")).otherwise(F.lit("Associate Justice")).alias("position"),
        S.strip(cell(5)).alias("replaced"),
        S.strip(F.try_element_at(appt_lines, F.lit(1))).alias("appointment_date"),
        F.when(F.size(appt_lines) > 1,
               F.regexp_replace(S.strip(F.try_element_at(appt_lines, F.lit(2))), r'^["()]+|["()]+$', ""))
         .otherwise(F.lit("")).alias("appointment_method"),
        tenure["tenure_start"].alias("tenure_start"), tenure["tenure_end"].alias("tenure_end"),
        tenure["tenure_status"].alias("tenure_status"),
        F.when(n > 8, S.strip(cell(8))).otherwise(F.lit("")).alias("tenure_length"),
        F.when(n > 9, S.strip(cell(9))).otherwise(F.lit("")).alias("nominated_by"),
    )


def parse_record_layout(df: DataFrame, json_col: str) -> DataFrame:
    """JSON ``[bios, description, target]`` or ``[..., locations]`` →
    struct columns; other lengths are flagged invalid with a message."""
    elems = F.from_json(F.col(json_col), "array<string>")
    n = F.size(elems)
    valid = n.isin(3, 4)
    return df.select(
        "*", n.cast("int").alias("n_elems"), valid.alias("valid"),
        F.when(valid, F.from_json(elems[0], "array<string>")).alias("bios"),
        F.when(valid, elems[1]).alias("description"),
        F.when(valid, F.from_json(elems[2], "array<double>")).alias("target"),
        F.when(n == 4, F.from_json(elems[3], "struct<bio:string,description:string>")).alias("locations"),
        F.when(valid, F.lit("")).otherwise(
            F.concat(F.lit("unexpected record layout with "), n.cast("string"), F.lit(" elements"))).alias("message"))
