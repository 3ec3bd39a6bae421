"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docket.session import checkpoint_dir

#: ASCII white space (blank, tab, line feed, vertical tab, form feed, return) as a regex class body.
BLANKS = r"\x20\x09-\x0D"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends here, and a lost
    executor costs no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of every row, null text as the empty text; other columns are left out,
    so that no column of the caller can clash with the operator's own."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def one_space(text: Column) -> Column:
    """Each run of ASCII white space as one space. Single spaces are not matched, so that
    ordinary prose is copied without a replacement per word."""
    return F.regexp_replace(text, rf"[\x09-\x0D][{BLANKS}]*|\x20[{BLANKS}]+", " ")


def tokenizer(name: str) -> str:
    """The place of a public tokenizer file; the files are read where they are, never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
