"""Document-level text operators built from the string column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket.functions import strings as S


def nonblank(c: Column) -> Column:
    return c.isNotNull() & (S.strip(c) != "")


def metadata_header(name: Column, state_full: Column, birth_death: Column, position: Column,
                    appointment_date: Column, appointment_method: Column, nominated_by: Column) -> Column:
    """``Justice:/State:/Birth Year:/Position:/Appointment Date:/Appointment
    Method:/Nominated By:`` lines (blank fields omitted) + a blank line."""
    by = S.birth_year(birth_death)
    clean_date = S.strip_date_notes(appointment_date)
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("Justice: "), name),
        F.when(F.coalesce(state_full, F.lit("")) != "", F.concat(F.lit("State: "), state_full)),
        F.when(by.isNotNull(), F.concat(F.lit("Birth Year: "), by)),
        F.when(F.coalesce(position, F.lit("")) != "", F.concat(F.lit("Position: "), position)),
        F.when(F.coalesce(clean_date, F.lit("")) != "", F.concat(F.lit("Appointment Date: "), clean_date)),
        F.when(nonblank(appointment_method), F.concat(F.lit("Appointment Method: "), appointment_method)),
        F.when(nonblank(nominated_by), F.concat(F.lit("Nominated By: "), nominated_by)),
    )
    return F.concat(lines, F.lit("\n\n"))


def clean_biography(bios: DataFrame, text_col: str = "text", header_col: str | None = "header") -> DataFrame:
    """Whole-bio transform: drop intro, cut at the court section, clean
    trailing whitespace, prefix the metadata header (when present), stats."""
    t = F.col(text_col)
    intro_pos = S.first_heading_pos(t)
    after = F.when(intro_pos > 0, S.strip(S.substr_from(t, intro_pos))).otherwise(t)
    sec = S.section_pos(after)
    cut = F.when(sec > 0, S.strip(after.substr(F.lit(1), sec - 1))).otherwise(after)
    cleaned = S.clean_trailing_ws(cut)
    processed = cleaned if header_col is None else \
        F.when(F.col(header_col).isNotNull(), F.concat(F.col(header_col), cleaned)).otherwise(cleaned)
    out = (bios
           .withColumn("intro_removed", intro_pos > 0)
           .withColumn("section_cut", sec > 0)
           .withColumn("processed", processed))
    return (out
            .withColumn("original_words", S.word_count(t))
            .withColumn("original_chars", F.length(t))
            .withColumn("processed_words", S.word_count(F.col("processed")))
            .withColumn("processed_chars", F.length("processed"))
            .withColumn("truncated", F.col("intro_removed") | F.col("section_cut"))
            .withColumn("reduction_words", F.col("original_words") - F.col("processed_words"))
            .withColumn("reduction_chars", F.col("original_chars") - F.col("processed_chars")))


def render_case_summary(case_name: Column, cite: Column, chief: Column, petitioner: Column,
                        petitioner_state: Column, respondent_state: Column, origin: Column,
                        origin_state: Column, issue: Column, body: Column) -> Column:
    """Step-8 summary: decoded parties/origin/issue, optional state clauses,
    then the description body.  Decoded inputs use '' for unknown codes."""
    def shown(x):
        return (F.coalesce(x, F.lit("")) != "") & (x != F.lit("Not specified"))

    return F.concat(
        F.lit("Case: "), F.coalesce(case_name, F.lit("nan")), F.lit(" ("), F.coalesce(cite, F.lit("nan")),
        F.lit(")\n\nThis Supreme Court case was decided under Chief Justice "), F.coalesce(chief, F.lit("nan")),
        F.lit(". The petitioner was "), petitioner,
        F.when(shown(petitioner_state), F.concat(F.lit(" from "), petitioner_state)).otherwise(F.lit("")),
        F.when(shown(respondent_state), F.concat(F.lit(". The respondent was from "), respondent_state))
         .otherwise(F.lit("")),
        F.lit(".\n\nThe case originated from "), origin,
        F.when(shown(origin_state), F.concat(F.lit(" in "), origin_state)).otherwise(F.lit("")),
        F.lit(". The primary issue area was "), issue, F.lit(".\n\n"), body,
    )


def _pct1(x: Column) -> Column:
    return F.format_string("%.1f", F.when(x != -1, x * F.lit(100.0)).otherwise(F.lit(0.0)))


def render_case_outcome(r: dict[str, Column]) -> Column:
    """Step-7 case text: parties, origin, issue, then the outcome paragraph
    (unclear branch, or favour/against/tie with margin and percentages).
    ``r`` maps case-table column names (and decoded labels) to columns."""
    def shown(x):
        return (x != F.lit("Not specified")) & (x != F.lit("Unknown state"))

    fav, ag, ab = r["votes_in_favor"], r["votes_against"], r["votes_absent"]
    disp = F.coalesce(r["caseDisposition"].cast("string"), F.lit("nan"))
    head = F.concat(
        F.lit("Case: "), F.coalesce(r["caseName"], F.lit("nan")), F.lit(" ("), F.coalesce(r["usCite"], F.lit("nan")),
        F.lit(")\n\nThis Supreme Court case was decided under Chief Justice "), F.coalesce(r["chief"], F.lit("nan")),
        F.lit(". The petitioner was "), r["petitioner_label"],
        F.when(shown(r["petitioner_state_label"]), F.concat(F.lit(" from "), r["petitioner_state_label"]))
         .otherwise(F.lit("")),
        F.when(shown(r["respondent_state_label"]),
               F.concat(F.lit(". The respondent was from "), r["respondent_state_label"])).otherwise(F.lit("")),
        F.lit("\n\nThe case originated from "), r["origin_label"],
        F.when(shown(r["origin_state_label"]), F.concat(F.lit(" in "), r["origin_state_label"])).otherwise(F.lit("")),
        F.lit(". The primary issue area was "), r["issue_label"], F.lit("."),
    )
    unclear = (fav == -1) | (ag == -1) | (ab == -1)
    outcome = (F.when(fav > ag, F.lit("ruled in favor of the petitioner"))
               .when(ag > fav, F.lit("ruled against the petitioner")).otherwise(F.lit("resulted in a tie")))
    margin = (F.when((fav > ag) & (ag == 0), F.lit("unanimous"))
              .when(fav > ag, F.concat_ws("-", fav.cast("string"), ag.cast("string")))
              .when(ag > fav, F.concat_ws("-", ag.cast("string"), fav.cast("string")))
              .otherwise(F.concat_ws("-", fav.cast("string"), ag.cast("string"))))
    clear = F.concat(
        F.lit("\n\nThe Supreme Court "), outcome, F.lit(" by a "), margin,
        F.lit(" margin. The voting breakdown was:\n- "), fav.cast("string"),
        F.lit(" justices voted in favor of the petitioner ("), _pct1(r["pct_in_favor"]), F.lit("%)\n- "),
        ag.cast("string"), F.lit(" justices voted against the petitioner ("), _pct1(r["pct_against"]), F.lit("%)"),
        F.when(ab > 0, F.concat(F.lit("\n- "), ab.cast("string"), F.lit(" justices were absent or recused ("),
                                _pct1(r["pct_absent"]), F.lit("%)"))).otherwise(F.lit("")),
        F.lit("\n\nThe majority opinion comprised "), F.coalesce(r["majVotes"].cast("string"), F.lit("nan")),
        F.lit(" justices, while "), F.coalesce(r["minVotes"].cast("string"), F.lit("nan")),
        F.lit(" justices were in the minority (case disposition code: "), disp, F.lit(")."),
    )
    unclear_text = F.concat(
        F.lit("\n\nThe case outcome could not be clearly determined from the available data (case disposition: "),
        disp, F.lit("). The court's decision on this case falls into an unclear category."))
    return F.concat(head, F.when(unclear, unclear_text).otherwise(clear))


def parse_doc_header(files: DataFrame, text_col: str = "text", ord_col: str = "file_ord") -> DataFrame:
    """Header ``Case ID:``/``Citation:`` lines before the first line starting
    ``====``; body after it.  Rows without id or body are dropped; for a
    repeated id the later file (by ordinal) wins."""
    t = F.col(text_col)
    rule = F.regexp_instr(t, F.lit(r"(?m)^===="))
    head = t.substr(F.lit(1), rule - 1)
    after_rule = S.substr_from(t, rule)
    nl = F.instr(after_rule, "\n")
    body = S.strip(F.when(nl > 0, S.substr_from(after_rule, nl + 1)).otherwise(F.lit("")))

    def last_field(label: str) -> Column:
        v = F.regexp_extract(head, rf"(?s)\A.*(?m:^){label}([^\n]*)", 1)
        has = F.regexp_instr(head, F.lit(rf"(?m)^{label}")) > 0
        return F.when(has, S.strip(F.replace(v, F.lit(label), F.lit(""))))

    parsed = files.select(
        F.col(ord_col), F.col("file_key"),
        F.when(rule > 0, last_field("Case ID:")).alias("case_id"),
        F.when(rule > 0, last_field("Citation:")).alias("citation"),
        F.when(rule > 0, body).alias("body"),
    ).filter((F.coalesce(F.col("case_id"), F.lit("")) != "") & (F.coalesce(F.col("body"), F.lit("")) != ""))
    return dedup_last(parsed, ["case_id"], ord_col)


def dedup_last(df: DataFrame, keys: Sequence[str], ord_col: str) -> DataFrame:
    """Keep the row with the greatest ordinal per key (one aggregate, no sort)."""
    cols = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col(ord_col)).alias("__r"))
    return agg.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in cols])


def dedup_first(df: DataFrame, keys: Sequence[str], ord_cols: Sequence[str]) -> DataFrame:
    """Keep the row with the smallest ordinal per key.  NULL keys form one
    group (as in pandas ``drop_duplicates``).  ``min_by`` is a partial
    aggregate, so a hot key is combined map-side before the shuffle."""
    cols = [c for c in df.columns if c not in keys]
    ordinal = F.struct(*[F.col(c) for c in ord_cols])
    agg = df.groupBy(*keys).agg(F.min_by(F.struct(*cols), ordinal).alias("__r"))
    return agg.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in cols])
