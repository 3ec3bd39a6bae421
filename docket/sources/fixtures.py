"""Binding of the pipeline's concepts to the driver's TPC-H-like tables.

Every binding here has a twin SQL text in ``docket.plans.bindings`` so the
DuckDB oracle sees exactly the same input.  All bindings are lazy DataFrames
over the whole tables: their work grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docket.sources.tables import table

# Lineitem columns that make up the vote ordinal (FIXTURES §3): only fully
# equal rows tie.
VOTE_ORD = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def case_id_col(orderkey: Column, orderdate: Column) -> Column:
    return F.concat(F.year(orderdate).cast("string"), F.lit("-"),
                    F.lpad(orderkey.cast("string"), 8, "0"))


def cases_base(spark: SparkSession, d: str) -> DataFrame:
    """One row per case (order) with its attributes and ordinal."""
    o = table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority", "o_totalprice")
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    j = o.join(c, o.o_custkey == c.c_custkey, "left")
    k = F.col("o_orderkey")
    return j.select(
        k.alias("case_ord"),
        case_id_col(k, F.col("o_orderdate")).alias("case_id"),
        F.year("o_orderdate").alias("year"),
        F.when(k % 50 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat((F.lit(300) + F.col("o_custkey") % 300).cast("string"), F.lit(" U.S. "),
                             k.cast("string"))).alias("usCite"),
        F.col("o_orderpriority").alias("chief"),
        F.concat(F.col("c_name"), F.lit(" v. "), F.col("o_orderstatus")).alias("caseName"),
        (F.col("o_custkey") % 260).cast("int").alias("petitioner"),
        F.col("c_nationkey").cast("int").alias("petitionerState"),
        F.when(k % 7 == 0, F.lit(None).cast("int"))
         .otherwise((F.col("o_custkey") % 61).cast("int")).alias("respondentState"),
        (k % 40).cast("int").alias("caseOrigin"),
        (k % 60).cast("int").alias("caseOriginState"),
        (k % 16).cast("int").alias("issueArea"),
        (k % 9).cast("int").alias("lawType"),
        F.when(k % 13 == 0, F.lit(None).cast("int")).otherwise((k % 13).cast("int")).alias("caseDisposition"),
        F.col("o_custkey"),
        F.col("o_totalprice"),
    )


def votes(spark: SparkSession, d: str, keep_order_key: bool = False) -> DataFrame:
    """Vote fact table (D1): one row per (case, member) = lineitem ⋈ orders.

    majVotes / minVotes are per-case counts of R / A lines: a partial
    aggregate joined to the cases before they meet the lines, so no window
    holds a case and a hot case can be split by the join.
    """
    li = table(spark, d, "lineitem").select("l_orderkey", *VOTE_ORD)
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    counts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("__k")).agg(
        F.count_if(F.col("l_returnflag") == "R").cast("int").alias("majVotes"),
        F.count_if(F.col("l_returnflag") == "A").cast("int").alias("minVotes"))
    cb = cases_base(spark, d)
    cb = cb.join(counts, cb.case_ord == counts["__k"])
    # supplier first, orders second: the last join's hash partitioning on the
    # order key is the one the tally reuses (two exchanges of lineitem when
    # the supplier table is too big to broadcast, not three)
    j = li.join(s, li.l_suppkey == s.s_suppkey, "left").join(cb, li.l_orderkey == cb.case_ord, "inner")
    out = j.select(
        "l_orderkey",
        F.col("case_id").alias("caseIssuesId"), "usCite", "chief", "caseName", "petitioner",
        "petitionerState", "respondentState", "caseOrigin", "caseOriginState", "issueArea",
        "lawType", F.col("s_name").alias("justiceName"),
        F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2)
         .when(F.col("l_returnflag") == "N", 8).cast("int").alias("vote"),
        "caseDisposition", "majVotes", "minVotes", *VOTE_ORD,
    )
    return out if keep_order_key else out.drop("l_orderkey")


def member_book(spark: SparkSession, d: str) -> DataFrame:
    """Member code → canonical name (supplier ⋈ nation); every 10th code is
    left out so the pass-through rule is exercised."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return (s.filter(F.col("s_suppkey") % 10 != 0)
            .join(n, s.s_nationkey == n.n_nationkey, "left")
            .select(F.col("s_name").alias("code"),
                    F.concat(F.lit("Justice "), F.substring("s_name", 10, 9), F.lit(" of "),
                             F.col("n_name")).alias("name")))
