"""Exact de-duplication by skew-safe combining, in DataFrame operations only.

Three steps, each comparing the full normalised content and not only its digest:

1. every task combines the equal texts it has read (the map side of the first aggregate);
2. groups of (digest, salt, text) are merged; the salt comes from the document id, so that a
   text with a third of all rows is merged by ``SALTS`` tasks;
3. the salt winners, at most ``SALTS`` rows per text, are combined to one winner per text.

The winners are written without their texts. Documents find their winner by (digest, salt), a
join whose hot keys are as split as step 2. A digest whose texts differ (never seen for SHA-256,
but possible) is found in step 3; its documents alone are joined on the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket.llm.common import one_space, stored, texts

#: One bit of a long per salt.
SALTS = 64


def _sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                digest=_sha256) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty ones. A null id is a row of its own and loses against any id; a
    group of null ids only has a null ``keep_id`` and keeps one row. Of rows that repeat both id
    and text one is kept. An empty table gives no rows. ``digest`` (text column -> string column)
    only decides who is compared; any function gives the same groups.
    """
    keyed = texts(docs, id_col, text_col).select(
        "doc_id", one_space(F.col("text")).alias("norm"))
    keyed = keyed.select("doc_id", "norm", digest(F.col("norm")).alias("digest"),
                         F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))

    merged = keyed.groupBy("digest", "salt", "norm").agg(
        F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    combined = merged.groupBy("digest", "norm").agg(
        F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"),
        F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts"))
    winners = stored(
        combined.groupBy("digest").agg(
            F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"),
            F.bit_or("salts").alias("salts"), F.count("*").alias("texts")),
        "dedup-winners")

    heads = winners.filter("texts = 1").select(
        "digest", F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), s -> (shiftright(salts, s) & 1L) = 1)")).alias("salt"),
        "keep_id", "n")
    members = keyed.groupBy("digest", "salt", "doc_id").agg(F.count("*").alias("times"))
    found = members.join(heads, ["digest", "salt"])
    if not winners.filter("texts > 1").isEmpty():
        clash = winners.filter("texts > 1").select("digest")
        rows = keyed.join(clash, "digest", "left_semi")
        one = rows.groupBy("digest", "norm", "salt").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
        one = one.groupBy("digest", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))
        rows = rows.groupBy("digest", "norm", "salt", "doc_id").agg(F.count("*").alias("times"))
        found = found.unionByName(
            rows.join(one, ["digest", "norm"]).select("digest", "salt", "doc_id", "times", "keep_id", "n"))
    return found.select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), F.col("digest").alias("text_sha256"),
        F.explode(F.expr("sequence(1L, times)")).alias("turn"),
    ).select("doc_id", "keep_id", "group_size",
             (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("turn") == 1)).alias("kept"),
             "text_sha256")
