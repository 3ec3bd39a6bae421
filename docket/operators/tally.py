"""Per-case vote tally (the flagship) and the outcome/share rules it uses.

One hash aggregate per case replaces the per-case boolean scan of the
original.  "First row" and the member string follow an explicit ordinal
(never input order, which Spark does not have).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket.functions import arrays as A

# Disposition codes where the petitioner wins / loses.
PETITIONER_WINS = [1, 3, 4, 5, 6, 7, 8]
PETITIONER_LOSES = [2, 9]

CASE_ATTRS = ["usCite", "chief", "caseName", "petitioner", "petitionerState", "respondentState",
              "caseOrigin", "caseOriginState", "issueArea", "lawType", "caseDisposition",
              "majVotes", "minVotes"]

REQUIRED_VOTE_COLUMNS = ["caseIssuesId", "usCite", "chief", "caseName", "petitioner",
                         "petitionerState", "respondentState", "caseOrigin", "caseOriginState",
                         "issueArea", "lawType", "justiceName", "vote", "caseDisposition",
                         "majVotes", "minVotes"]


def disposition_outcome(disposition: Column) -> Column:
    """1,3..8 → 'in favour'; 2,9 → 'against'; anything else or NULL → 'unclear'."""
    return (F.when(disposition.isin(PETITIONER_WINS), F.lit("in favour"))
            .when(disposition.isin(PETITIONER_LOSES), F.lit("against"))
            .otherwise(F.lit("unclear")))


def vote_counts(disposition: Column, maj: Column, mino: Column) -> Column:
    """struct(votes_in_favor, votes_against, votes_absent, pct_*) with the −1
    sentinel for unclear/missing; absent = 9 − maj − min may be negative."""
    known = disposition.isNotNull() & maj.isNotNull() & mino.isNotNull()
    wins = known & disposition.isin(PETITIONER_WINS)
    loses = known & disposition.isin(PETITIONER_LOSES)
    favor = F.when(wins, maj).when(loses, mino).otherwise(F.lit(-1))
    against = F.when(wins, mino).when(loses, maj).otherwise(F.lit(-1))
    absent = F.when(wins | loses, F.lit(9) - maj - mino).otherwise(F.lit(-1))
    nine = F.lit(9.0).cast("double")

    def pct(x):
        return F.when(wins | loses, x.cast("double") / nine).otherwise(F.lit(-1.0))

    return F.struct(
        favor.cast("int").alias("votes_in_favor"),
        against.cast("int").alias("votes_against"),
        absent.cast("int").alias("votes_absent"),
        pct(favor).alias("pct_in_favor"),
        pct(against).alias("pct_against"),
        pct(absent).alias("pct_absent"),
    )


def ordered_join(items: Column, sep: str) -> Column:
    """array<struct<o: ordinal, v: string>> → v's joined in ordinal order."""
    return F.array_join(A.in_order(items, "v"), sep)


def vote_tally(votes: DataFrame, ord_cols: Sequence[str], key_cols: Sequence[str] = ("caseIssuesId",),
               chunk: Column | None = None, attrs: Sequence[str] = CASE_ATTRS) -> DataFrame:
    """Vote fact (one row per case × member) → case table (22 columns; of the
    case's own columns only ``attrs``, which the outcome's are always among).

    ``key_cols`` may carry extra columns that the case id is a function of
    (e.g. the physical order key) so an upstream hash partitioning on them is
    reused and the aggregate needs no second shuffle.

    ``chunk`` is a column that does not fall along the ordinal (a coarse
    position).  Votes are then gathered and ordered per (case, chunk), and
    only the chunks' strings meet per case: a case with a third of all votes
    is sorted by many tasks.
    """
    ordinal = F.struct(*[F.col(c) for c in ord_cols])
    names = [c for c in CASE_ATTRS if c in {*attrs, "caseDisposition", "majVotes", "minVotes"}]
    attrs = F.struct(*[F.col(c) for c in names])
    member = F.concat(F.coalesce(F.col("justiceName"), F.lit("None")), F.lit(":"),
                      F.coalesce(F.col("vote").cast("string"), F.lit("nan")))
    part = F.lit(0) if chunk is None else chunk
    parts = (votes.filter(F.col("caseIssuesId").isNotNull())
             .groupBy(*key_cols, part.alias("__chunk"))
             .agg(F.min_by(attrs, ordinal).alias("a"), F.count(F.lit(1)).alias("n"),
                  ordered_join(F.collect_list(F.struct(ordinal.alias("o"), member.alias("v"))), "; ").alias("v")))
    if chunk is None:
        agg = parts.select(*key_cols, "a", F.col("n").cast("int").alias("total_justices_voting"), F.col("v").alias("justice_votes"))
    else:
        agg = parts.groupBy(*key_cols).agg(
            F.min_by("a", "__chunk").alias("a"), F.sum("n").cast("int").alias("total_justices_voting"),
            ordered_join(F.collect_list(F.struct(F.col("__chunk").alias("o"), F.col("v").alias("v"))), "; ").alias("justice_votes"))
    counts = vote_counts(F.col("a.caseDisposition"), F.col("a.majVotes"), F.col("a.minVotes"))
    return agg.select(
        "caseIssuesId",
        *[F.col(f"a.{c}").alias(c) for c in names],
        "total_justices_voting",
        counts["votes_in_favor"].alias("votes_in_favor"),
        counts["votes_against"].alias("votes_against"),
        counts["votes_absent"].alias("votes_absent"),
        counts["pct_in_favor"].alias("pct_in_favor"),
        counts["pct_against"].alias("pct_against"),
        counts["pct_absent"].alias("pct_absent"),
        "justice_votes",
    )
