"""Training-record assembly (D6) and the joins it is made of.

A record is ``struct(case_id, bios array<string>, description string,
target array<double>)`` with an optional ``locations`` struct.  File
existence checks of the original become semi/left joins against key tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket.functions import arrays as A
from docket.functions import strings as S
from docket.operators.decode import parse_share_sentinel

BIO_DIR = "data/processed/bios/"
DESC_DIR = "data/processed/case_descriptions/"


def citation_key(cite: Column) -> Column:
    """Citation → description file stem (spaces → ``_``); NULL/'nan'/'' → NULL."""
    return F.when(cite.isNull() | (cite == "nan") | (cite == ""), F.lit(None).cast("string")) \
        .otherwise(F.replace(cite, F.lit(" "), F.lit("_")))


def join_by_citation(cases: DataFrame, desc_keys: DataFrame, cite_col: str = "usCite",
                     key_col: str = "file_key", out: str = "description") -> DataFrame:
    """Case ⟕ description store on the normalised citation; ``out`` is the
    description path or NULL.  ``desc_keys`` is deduplicated first so the
    left join can never multiply case rows."""
    keys = desc_keys.select(F.col(key_col).alias("__dk")).distinct()
    j = cases.withColumn("__ck", citation_key(F.col(cite_col))).join(keys, F.col("__ck") == F.col("__dk"), "left")
    return j.withColumn(out, F.when(F.col("__dk").isNotNull(),
                                    F.concat(F.lit(DESC_DIR), F.col("__dk"), F.lit(".txt")))).drop("__ck", "__dk")


def member_lookup(member_book: DataFrame, bio_keys: DataFrame) -> DataFrame:
    """code → (name, has_bio) for every code that can resolve to a bio: book
    codes (name from the book) plus, for pass-through codes, bio keys that
    are not book codes (name = code).  Sized by the member tables only."""
    bios = bio_keys.select(F.col("key").alias("__bk")).distinct()
    book = member_book.select(F.col("code").alias("lk_code"), F.col("name").alias("lk_name"))
    in_book = (book.join(bios, F.col("lk_name") == F.col("__bk"), "left")
               .select("lk_code", "lk_name", F.col("__bk").isNotNull().alias("lk_bio")))
    passthrough = (bios.join(book.select(F.col("lk_code").alias("__c")), F.col("__bk") == F.col("__c"), "left_anti")
                   .select(F.col("__bk").alias("lk_code"), F.col("__bk").alias("lk_name"), F.lit(True).alias("lk_bio")))
    # a member listed twice must not multiply votes; names are kept once per case anyway
    return in_book.unionByName(passthrough).distinct()


def vote_members(cases: DataFrame, member_book: DataFrame, bio_keys: DataFrame,
                 key_col: str = "caseIssuesId", votes_col: str = "justice_votes") -> DataFrame:
    """Parse ``code:vote; …`` → names (book, pass-through) → keep names that
    have a bio → (case, bios array in first-vote order, each name once).

    One join of the exploded votes against the member-sized lookup and one
    ``groupBy`` per case; the per-case list is bounded by the case's votes.
    """
    parts = cases.select(F.col(key_col).alias("case_id"),
                         F.posexplode(F.split(F.col(votes_col), ";")).alias("pos", "part"))
    codes = (parts.filter(S.strip(F.col("part")) != "")
             .withColumn("code", F.split(S.strip(F.col("part")), ":").getItem(0)))
    lk = member_lookup(member_book, bio_keys)
    named = codes.join(lk, F.col("code") == F.col("lk_code"), "left").filter(F.coalesce("lk_bio", F.lit(False)))
    ordered = A.in_order(F.collect_list(F.struct("pos", F.col("lk_name").alias("name"))), "name")
    return (named.groupBy("case_id").agg(F.array_distinct(ordered).alias("__names"))
            .select("case_id", F.transform("__names", lambda n: F.concat(F.lit(BIO_DIR), n, F.lit(".txt")))
                    .alias("bios")))


def assemble_training_records(cases: DataFrame, member_book: DataFrame, bio_keys: DataFrame,
                              desc_keys: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Case table + description store + bios + targets → D6 records.

    Of several rows with one case id the first in ``order`` makes the record
    (without ``order``: the least by its own columns), whole and alone.
    Single pass over the case table: the description is attached, the votes are
    exploded with the case's own columns attached, joined once to the member
    lookup and gathered back per case (cases without any bio keep an empty list).
    The description is among the keys, so that where only records with one are
    asked for, the others' votes are not exploded.
    Targets parse the share columns with the −1 sentinel.
    """
    lk = member_lookup(member_book, bio_keys)
    shares = ["pct_in_favor", "pct_against", "pct_absent"]
    own = ["usCite", *shares, "justice_votes"]
    # the row is held once, not beside what it is compared by
    first = cases.groupBy(F.col("caseIssuesId").alias("case_id")).agg(
        F.min(F.struct(F.struct(*order, F.lit(0).alias("__last")).alias("order"), F.struct(*own).alias("own"))).alias("__r"))
    described = join_by_citation(first.select("case_id", "__r.own.*"), desc_keys)
    parts = described.select("case_id", "description", *shares, F.posexplode_outer(F.split(F.col("justice_votes"), ";")).alias("pos", "part"))
    # as ``S.strip`` and a split, without a regex per vote
    vote = F.btrim(F.col("part"), F.lit("\t\n\x0b\f\r "))
    j = parts.withColumn("code", F.when(vote != "", F.substring_index(vote, ":", 1))).join(lk, F.col("code") == F.col("lk_code"), "left")
    named = F.when(F.coalesce(F.col("lk_bio"), F.lit(False)), F.struct("pos", F.col("lk_name").alias("name")))
    base = j.groupBy("case_id", "description").agg(
        *[F.any_value(c).alias(c) for c in shares],
        F.array_distinct(A.in_order(F.collect_list(named), "name")).alias("__names"))

    def share(c):
        return parse_share_sentinel(F.col(c).cast("string"))

    return base.select(
        "case_id",
        F.transform("__names", lambda n: F.concat(F.lit(BIO_DIR), n, F.lit(".txt"))).alias("bios"),
        "description",
        F.array(share("pct_in_favor"), share("pct_against"), share("pct_absent")).alias("target"))


def add_locations(records: DataFrame, bio_store: str | None, desc_store: str | None) -> DataFrame:
    """Attach ``locations`` = struct(bio store, description store), NULL for a
    missing store; records that already carry one are overwritten."""
    loc = F.struct(F.lit(bio_store).cast("string").alias("bio"),
                   F.lit(desc_store).cast("string").alias("description"))
    return records.withColumn("locations", loc)
