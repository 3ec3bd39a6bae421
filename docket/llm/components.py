"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docket.llm.common import stored


def _hung(links: DataFrame, smaller_only: bool) -> DataFrame:
    """One star step on links (a, b) with a > b: every node hangs (some of) its neighbours, and in
    the small star itself, on its least neighbour."""
    both = links if smaller_only else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low"))
    if smaller_only:
        moved = both.join(least, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        return moved.unionByName(least.select("a", F.col("low").alias("b"))).distinct()
    least = least.select("a", F.least("a", "low").alias("low"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").unionByName(
        both.join(least, "a").filter("b < a and b <> low and a = low").select(F.col("a"), F.col("low").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); the root is the component's least node.

    Each step writes its links to the shared folder, so a lost executor costs one step. The number
    of steps grows with the logarithm of the longest path. An empty table gives no rows.
    """
    state = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    mark = None
    while True:
        seen = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if tuple(seen) == mark:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = tuple(seen)
        if seen[0] == 0:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = stored(_hung(_hung(state, False), True), "links")
