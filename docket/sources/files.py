"""File sources and sinks.

Readers take explicit schemas (no inference).  Writers produce partitioned
columnar tables — never one file per row — under a folder the caller names;
on a cluster that is a shared path (e.g. below ``spark.checkpoint.dir``).
"""

from __future__ import annotations

import datetime as dt
import weakref
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docket.functions import strings as S
from docket.session import scratch_path

VOTE_INT_COLUMNS = ["petitioner", "petitionerState", "respondentState", "caseOrigin", "caseOriginState",
                    "issueArea", "lawType", "vote", "caseDisposition", "majVotes", "minVotes"]
VOTES_SCHEMA = T.StructType(
    [T.StructField(c, T.IntegerType() if c in VOTE_INT_COLUMNS else T.StringType())
     for c in ["caseIssuesId", "usCite", "chief", "caseName", "petitioner", "petitionerState", "respondentState",
               "caseOrigin", "caseOriginState", "issueArea", "lawType", "justiceName", "vote", "caseDisposition",
               "majVotes", "minVotes"]])


class MissingColumns(ValueError):
    pass


def scan_csv_votes(spark: SparkSession, path: str, all_strings: bool = False) -> DataFrame:
    """Header CSV scan of the vote fact.  Codes that arrive as floats
    (``27.0``) are read as text and converted with ``try_cast`` so a
    malformed value becomes NULL instead of failing the job."""
    if all_strings:
        schema = T.StructType([T.StructField(f.name, T.StringType()) for f in VOTES_SCHEMA.fields])
        return spark.read.schema(schema).option("header", True).csv(path)
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in VOTES_SCHEMA.fields])
    raw = spark.read.schema(text).option("header", True).csv(path)
    return raw.select(*[F.col(f.name).try_cast("double").try_cast("int").alias(f.name)
                        if f.name in VOTE_INT_COLUMNS else F.col(f.name) for f in VOTES_SCHEMA.fields])


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fail naming the missing columns, else project to ``cols``."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise MissingColumns(f"Missing columns: {missing}")
    return df.select(*cols)


def _folder(spark: SparkSession, path: str):
    """(file system, Hadoop path) of a folder, through Spark's own file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``; none where it does not exist.  Other errors surface."""
    fs, p = _folder(spark, path)
    if not fs.exists(p):
        return []
    return [st.getPath().getName() for st in fs.listStatus(p) if st.isDirectory()]


def committed(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` has finished (Spark's commit marker is there)."""
    fs, p = _folder(spark, path)
    return bool(fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def bytes_of(spark: SparkSession, path: str) -> int:
    """Bytes of all files below ``path``."""
    fs, p = _folder(spark, path)
    return int(fs.getContentSummary(p).getLength())


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that a writer of this library made."""
    fs, p = _folder(spark, path)
    fs.delete(p, True)


def scan_json_map(spark: SparkSession, path: str, value_schema: T.DataType | None = None, key_name: str = "key",
                  whole_file: bool = False) -> DataFrame:
    """JSON object(s) keyed by id → one row per entry.

    ``whole_file``: each file is one object, on one line or indented (read by
    one task per file, as the format asks for).  Otherwise, at scale, one
    object per line (JSON Lines).  ``value_schema`` is a struct (its fields
    become columns); without one the values stay JSON text in ``value``, for
    lists of mixed types.  A record that is no such object fails the job.
    """
    value = T.StringType() if value_schema is None else value_schema
    lines = spark.read.text(path, wholetext=whole_file).filter(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", T.MapType(T.StringType(), value), {"mode": "FAILFAST"}).alias("m"))
    # a null map (an empty or non-object record) is an error too, not zero rows
    whole = F.when(F.col("m").isNull(), F.raise_error(F.lit(f"not a JSON object keyed by id: {path}"))).otherwise(F.col("m"))
    e = parsed.select(F.explode(whole).alias(key_name, "value"))
    return e if value_schema is None else e.select(key_name, "value.*")


def write_json_map(df: DataFrame, path: str, key_col: str) -> None:
    """JSON Lines, one ``{key: record}`` object per line."""
    rest = [c for c in df.columns if c != key_col]
    df.select(F.to_json(F.create_map(F.col(key_col), F.struct(*rest))).alias("value")) \
        .write.mode("overwrite").text(path)


def write_json_objects(entries: DataFrame, path: str, key_col: str, json_col: str, per_file: int) -> None:
    """Indented whole-file objects of at most ``per_file`` entries each, keys in order;
    ``json_col`` holds each value as JSON text."""
    from docket.operators.splits import global_rank

    ranked = global_rank(entries.select(key_col, json_col), [F.col(key_col).asc()])
    entry = F.concat(F.lit("  "), F.to_json(F.col(key_col).cast("string").cast("variant")), F.lit(": "), F.col(json_col))
    objects = ranked.select(F.floor((F.col("rn") - 1) / per_file).alias("f"), "rn", entry.alias("e")).groupBy("f").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "e"))), lambda x: x["e"]), ",\n").alias("body"))
    objects.select(F.concat(F.lit("{\n"), "body", F.lit("\n}")).alias("value"), "f").repartition("f") \
        .write.mode("overwrite").partitionBy("f").option("lineSep", "\n").text(path)


def scan_text_dir(spark: SparkSession, path: str, key_col: str = "key") -> DataFrame:
    """One row per ``.txt`` file: key = the file stem; text stripped; empty files dropped."""
    df = (spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).text(path, wholetext=True)
          .select("*", F.col("_metadata.file_name").alias("__f")))
    out = df.select(F.regexp_replace("__f", r"\.txt$", "").alias(key_col), S.strip(F.col("value")).alias("text"))
    return out.filter(F.col("text") != "")


#: Folders that a keyed text store is cut into.
TEXT_BUCKETS = 64


def write_keyed_text(df: DataFrame, path: str, key_col: str, text_col: str = "text") -> None:
    """Keyed texts as JSON Lines in a fixed number of key buckets, the key beside its text: no file per row."""
    df.select(F.col(key_col).cast("string").alias("key"), F.col(text_col).alias("text"),
              F.pmod(F.xxhash64(F.col(key_col).cast("string")), F.lit(TEXT_BUCKETS)).cast("int").alias("bucket")) \
        .repartition("bucket").write.mode("overwrite").partitionBy("bucket").json(path)


def scan_keyed_text(spark: SparkSession, path: str, key_col: str = "key") -> DataFrame:
    """Rows of ``write_keyed_text``: text stripped; empty texts dropped."""
    df = spark.read.schema("key string, text string, bucket int").json(path)
    return df.select(F.col("key").alias(key_col), S.strip(F.col("text")).alias("text")).filter(F.col("text") != "")


def scan_listed_files(files: DataFrame, listed: DataFrame, key_col: str = "key") -> tuple[DataFrame, DataFrame]:
    """Restrict a scan to a list: (found = files ⋉ list, missing = list ▷ files)."""
    found = files.join(listed.select(key_col).distinct(), key_col, "left_semi")
    missing = listed.select(key_col).distinct().join(files.select(key_col), key_col, "left_anti")
    return found, missing


#: Session setting: the shuffle files of a query are removed when it has ended, not when the driver next collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new folder below the shared checkpoint folder and read it again: lineage ends here,
    a lost executor costs no recomputation, and the write's shuffle files go at once."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def discard(*frames: DataFrame) -> None:
    """Remove the folders of ``stored`` tables that nothing reads any more."""
    for df in frames:
        drop_folder(df.sparkSession, _folders.pop(df))


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def sink_case_csv(cases: DataFrame, path: str) -> None:
    cases.write.mode("overwrite").option("header", True).csv(path)


def read_case_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def save_token_store(tokens: DataFrame, meta: dict, path: str, failed: DataFrame | None = None) -> None:
    """Token arrays table, a one-row metadata table with the number of stored
    entries as written, and the keys that could not be encoded."""
    spark = tokens.sparkSession
    tokens.write.mode("overwrite").parquet(f"{path}/tokens")
    stored = spark.read.parquet(f"{path}/tokens")
    row = stored.agg(F.count(F.lit(1)).alias("num_tokenized"))
    row.select("num_tokenized", *[F.lit(v).alias(k) for k, v in meta.items()]).write.mode("overwrite").parquet(f"{path}/metadata")
    lost = failed if failed is not None else stored.limit(0).select(F.col("key").cast("string").alias("key"))
    lost.select(F.col("key").cast("string").alias("key")).write.mode("overwrite").parquet(f"{path}/failed")


def load_token_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/tokens"), spark.read.parquet(f"{path}/metadata")


def merge_token_stores(spark: SparkSession, old: str, new: str, out: str) -> None:
    """Union of two token stores by key, the new one's entries winning; the metadata holds the merged
    count and both sources."""
    from docket.operators.setops import upsert_new_wins

    (a, meta_a), (b, meta_b) = load_token_store(spark, old), load_token_store(spark, new)
    keep = meta_b.drop("num_tokenized").first().asDict()  # one row
    save_token_store(upsert_new_wins(a, b, ["key"]).drop("src"), keep | {"sources": f"{old},{new}"}, out)


def holdout_store(spark: SparkSession, path: str, compute, source: str, force: bool = False) -> DataFrame:
    """Holdout ids with header fields.  Reloads the stored table unless it is
    missing or ``force``; otherwise computes, writes, then reads back."""
    if not force and committed(spark, path):
        return spark.read.parquet(path)
    ids = compute()
    created = dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")
    total = ids.agg(F.count(F.lit(1))).scalar()
    out = ids.select(F.col("case_id"), F.lit("most recent cases with descriptions").alias("description"),
                     F.lit(created).alias("creation_date"), total.alias("total_cases"),
                     F.lit(source).alias("source_dataset"))
    out.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


TRIAL_LOG_SCHEMA = T.StructType([
    T.StructField("trial_number", T.LongType()), T.StructField("trial_status", T.StringType()),
    T.StructField("start", T.StringType()), T.StructField("end", T.StringType()),
    T.StructField("duration_seconds", T.DoubleType()), T.StructField("combined_metric", T.DoubleType()),
    T.StructField("val_loss", T.DoubleType()), T.StructField("val_f1_macro", T.DoubleType()),
    T.StructField("experiment_name", T.StringType())])


def sink_trial_log(rows: DataFrame, path: str) -> None:
    """Append result rows with the fixed schema (the header is the schema)."""
    rows.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in TRIAL_LOG_SCHEMA.fields]) \
        .write.mode("append").parquet(path)
