"""The corpus pipeline: five stages over the documents table, each written and reread by the next.

Every stage learns from and decides on all documents that the one before kept. ORACLE_SQL is None:
SQL cannot express the two classifiers and the packing plan; tests compare the stages with
brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docket.llm.common import one_space, stored, tokenizer
from docket.llm.exact_dedup import exact_dedup
from docket.llm.language_id import UNKNOWN, identify
from docket.llm.ngram_join import near_duplicates
from docket.llm.packing import pack
from docket.llm.toxicity import toxicity
from docket.sources.tables import table

#: Documents whose best language is less likely than this are rejected.
LEAST_LANGUAGE_SCORE = 0.5

ORACLE_SQL = None


def _only(docs: DataFrame, key: Column, chosen: DataFrame) -> DataFrame:
    """The documents whose (doc_id, key) is chosen; of rows that repeat both, one."""
    # a null id is a key of its own
    pair = [F.coalesce(F.col("doc_id").cast("string"), F.lit("none")).alias("_id"), key.alias("_key")]
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_row"), *pair)
    wanted = chosen.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")).alias("_id"), F.col("key").alias("_key")).distinct()
    turn = F.row_number().over(Window.partitionBy("_id", "_key").orderBy("_id"))
    return rows.join(wanted, ["_id", "_key"]).withColumn("_turn", turn).filter("_turn = 1").select("_row.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: not ``und``, and likely enough."""
    found = identify(docs, whole=True)
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return toxicity(docs, table(spark, sf_dir, "labels"), whole=True).filter("predicted = 0").select("row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal normalised texts."""
    kept = exact_dedup(docs).filter("kept").select("doc_id", F.col("text_sha256").alias("key"))
    return _only(docs, F.sha2(one_space(F.coalesce("text", F.lit(""))), 256), kept)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word n-grams, Jaccard similarity 0.8 or more."""
    kept = near_duplicates(docs).filter("kept").select("doc_id", F.col("text_key").alias("key"))
    return _only(docs, F.xxhash64(F.coalesce("text", F.lit(""))), kept)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document that is left, packed into sequences."""
    return pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage is written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
