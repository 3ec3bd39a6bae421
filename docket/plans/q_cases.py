"""Queries over the vote fact and case table."""

from __future__ import annotations

from pyspark.sql import functions as F

from docket.operators import tally
from docket.plans.bindings import VOTE_ORD_SQL, with_
from docket.plans.registry import query
from docket.sources import fixtures as fx


def case_table(spark, d, attrs=tally.CASE_ATTRS):
    """The tally over the whole vote fact, grouped on (order key, case id)
    so the join's hash partitioning on the order key is reused.  The line
    number leads the vote ordinal, so runs of line numbers are its chunks."""
    v = fx.votes(spark, d, keep_order_key=True)
    return tally.vote_tally(v, fx.VOTE_ORD, key_cols=("l_orderkey", "caseIssuesId"),
                            chunk=F.floor(F.col("l_linenumber") / 1024), attrs=attrs).drop("l_orderkey")


TALLY_SQL = f"""
SELECT caseIssuesId,
       first(usCite ORDER BY {VOTE_ORD_SQL}) AS usCite,
       first(chief ORDER BY {VOTE_ORD_SQL}) AS chief,
       first(caseName ORDER BY {VOTE_ORD_SQL}) AS caseName,
       first(petitioner ORDER BY {VOTE_ORD_SQL}) AS petitioner,
       first(petitionerState ORDER BY {VOTE_ORD_SQL}) AS petitionerState,
       first(respondentState ORDER BY {VOTE_ORD_SQL}) AS respondentState,
       first(caseOrigin ORDER BY {VOTE_ORD_SQL}) AS caseOrigin,
       first(caseOriginState ORDER BY {VOTE_ORD_SQL}) AS caseOriginState,
       first(issueArea ORDER BY {VOTE_ORD_SQL}) AS issueArea,
       first(lawType ORDER BY {VOTE_ORD_SQL}) AS lawType,
       first(caseDisposition ORDER BY {VOTE_ORD_SQL}) AS caseDisposition,
       first(majVotes ORDER BY {VOTE_ORD_SQL}) AS majVotes,
       first(minVotes ORDER BY {VOTE_ORD_SQL}) AS minVotes,
       CAST(count(*) AS INTEGER) AS total_justices_voting,
       string_agg(coalesce(justiceName, 'None') || ':' || coalesce(CAST(vote AS VARCHAR), 'nan'), '; '
                  ORDER BY {VOTE_ORD_SQL}) AS justice_votes
FROM {{votes}} WHERE caseIssuesId IS NOT NULL GROUP BY caseIssuesId"""

SHARES_SQL = """
SELECT t.*,
  CASE WHEN caseDisposition IN (1,3,4,5,6,7,8) AND majVotes IS NOT NULL AND minVotes IS NOT NULL THEN 'W'
       WHEN caseDisposition IN (2,9) AND majVotes IS NOT NULL AND minVotes IS NOT NULL THEN 'L' END AS _o
FROM {tally_raw} t"""

CASES_SQL = """
SELECT caseIssuesId, usCite, chief, caseName, petitioner, petitionerState, respondentState, caseOrigin,
  caseOriginState, issueArea, lawType, caseDisposition, majVotes, minVotes, total_justices_voting,
  CAST(CASE _o WHEN 'W' THEN majVotes WHEN 'L' THEN minVotes ELSE -1 END AS INTEGER) AS votes_in_favor,
  CAST(CASE _o WHEN 'W' THEN minVotes WHEN 'L' THEN majVotes ELSE -1 END AS INTEGER) AS votes_against,
  CAST(CASE WHEN _o IS NOT NULL THEN 9 - majVotes - minVotes ELSE -1 END AS INTEGER) AS votes_absent,
  CASE _o WHEN 'W' THEN CAST(majVotes AS DOUBLE) / 9 WHEN 'L' THEN CAST(minVotes AS DOUBLE) / 9 ELSE -1.0 END AS pct_in_favor,
  CASE _o WHEN 'W' THEN CAST(minVotes AS DOUBLE) / 9 WHEN 'L' THEN CAST(majVotes AS DOUBLE) / 9 ELSE -1.0 END AS pct_against,
  CASE WHEN _o IS NOT NULL THEN CAST(9 - majVotes - minVotes AS DOUBLE) / 9 ELSE -1.0 END AS pct_absent,
  justice_votes
FROM {tally_o}"""

from docket.plans import bindings as _b  # noqa: E402

_b.define("tally_raw", ("votes",), TALLY_SQL)
_b.define("tally_o", ("tally_raw",), SHARES_SQL)
_b.define("cases", ("tally_o",), CASES_SQL)


@query("vote_tally", sql=with_("cases") + "SELECT * FROM cases")
def q_vote_tally(spark, d):
    return case_table(spark, d)
