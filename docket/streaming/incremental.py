"""Incremental ingest and upsert with Structured Streaming.

The original skips items whose output already exists and merges new token entries into a keyed store.
Here new input files are picked up by a file stream with a checkpoint, ``trigger(availableNow=True)`` drains
what is there and stops, and ``foreachBatch`` writes one folder per micro-batch.

* ``incremental_ingest`` works by item: rows whose key has been processed before, in whatever file, are
  skipped.  A batch reads the keys, and only those, of the buckets it touches.
* ``incremental_upsert`` keeps a log-structured store.  A batch writes its own rows as a delta
  (``delta/v=<batch id>``) and nothing else.  Readers merge: of a key's rows the newest version wins.  When the
  deltas have grown to ``COMPACT_SHARE`` of the base, base and deltas are written as a new base; older
  folders are dropped after it is committed, but for the generation before, which readers may still hold.

Folders count once Spark's commit marker is in them.  A batch reads only folders before its own, so a batch
that is replayed writes the same folder from the same input; one that a base already holds is done.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docket.sources.files import bytes_of, committed, drop_folder, subfolders

BUCKETS = 64
#: Bytes of the deltas, as a share of the base's, from which on they are compacted.
COMPACT_SHARE = 0.5


def version_path(store: str, version: int, kind: str = "delta") -> str:
    return f"{store.rstrip('/')}/{kind}/v={version:08d}"


def bucket_of(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def _versions(spark: SparkSession, store: str, kind: str, below: int | None = None) -> list[int]:
    """Committed versions; only an absent store counts as empty, other errors surface."""
    found = [int(name[2:]) for name in subfolders(spark, f"{store.rstrip('/')}/{kind}") if name.startswith("v=")]
    return sorted(v for v in found if (below is None or v < below) and committed(spark, version_path(store, v, kind)))


def _layers(spark: SparkSession, store: str, below: int | None = None) -> tuple[int | None, list[int]]:
    """(version of the newest base, versions of the deltas after it)."""
    bases = _versions(spark, store, "base", below)
    base = bases[-1] if bases else None
    return base, [v for v in _versions(spark, store, "delta", below) if base is None or v > base]


def _merged(spark: SparkSession, store: str, schema: T.StructType, keys: Sequence[str], below: int | None = None) -> DataFrame:
    """The current rows, with ``bucket``: of a key's rows the one of the newest version."""
    base, deltas = _layers(spark, store, below)
    paths = [(v, version_path(store, v, "delta")) for v in deltas] + ([] if base is None else [(base, version_path(store, base, "base"))])
    fields = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
    rows = None
    for version, path in paths:
        some = spark.read.schema(fields).parquet(path).withColumn("__v", F.lit(version))
        rows = some if rows is None else rows.unionByName(some)
    if rows is None:
        return spark.createDataFrame([], fields)
    if len(paths) == 1:
        return rows.drop("__v")
    names = [f.name for f in fields]
    newest = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max_by(F.struct(*names), "__v").alias("__r"))
    return newest.select("__r.*")


def latest_store(spark: SparkSession, store: str, schema: T.StructType, keys: Sequence[str] = ("key",)) -> DataFrame:
    """The current rows of the store (empty when there is none)."""
    return _merged(spark, store, schema, keys).drop("bucket")


def compact(spark: SparkSession, store: str, schema: T.StructType, keys: Sequence[str], share: float = COMPACT_SHARE) -> bool:
    """Write a new base if the deltas weigh at least ``share`` of the base, then drop what it replaces; whether it did."""
    base, deltas = _layers(spark, store)
    if not deltas:
        return False
    weight = sum(bytes_of(spark, version_path(store, v)) for v in deltas)
    if base is not None and weight < share * bytes_of(spark, version_path(store, base, "base")):
        return False
    rows = _merged(spark, store, schema, keys)
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(version_path(store, deltas[-1], "base"))
    # what the base before this one needs is kept: a reader may have listed it just before
    for kind in ("base", "delta"):
        for name in subfolders(spark, f"{store.rstrip('/')}/{kind}"):
            version = int(name[2:]) if name.startswith("v=") else None
            if version is not None and base is not None and (version < base or kind == "delta" and version <= base):
                drop_folder(spark, version_path(store, version, kind))
    return True


def upsert_batch(batch: DataFrame, batch_id: int, store: str, schema: T.StructType, keys: Sequence[str],
                 ordinal: Sequence[str], share: float = COMPACT_SHARE) -> None:
    """Add one increment: of repeated keys the row with the greatest ``ordinal`` wins, and new rows win over
    stored ones.  Writes the increment's own rows, and now and then a compacted base."""
    spark = batch.sparkSession
    bases = _versions(spark, store, "base")
    if bases and bases[-1] >= batch_id:
        return  # a replay of a batch that the base holds
    rows = [f.name for f in schema.fields]
    last = batch.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(
        F.max_by(F.struct(*rows), F.struct(*ordinal)).alias("__r")).select("__r.*")
    last.withColumn("bucket", bucket_of(keys)).write.mode("overwrite").partitionBy("bucket").parquet(version_path(store, batch_id))
    compact(spark, store, schema, keys, share)


def incremental_upsert(spark: SparkSession, source_dir: str, schema: T.StructType, store: str, checkpoint: str,
                       keys: Sequence[str], ordinal: Sequence[str]) -> None:
    """Merge each increment into the keyed store.  ``schema`` is the store's;
    the increments also hold the ``ordinal`` columns."""
    known = {f.name for f in schema.fields}
    read = T.StructType([*schema.fields, *[T.StructField(c, T.LongType()) for c in ordinal if c not in known]])

    def merge(batch: DataFrame, batch_id: int) -> None:
        upsert_batch(batch, batch_id, store, schema, keys, ordinal)

    _drained(spark.readStream.schema(read).parquet(source_dir), merge, checkpoint)


def _drained(stream: DataFrame, each, checkpoint: str) -> None:
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def _items(spark: SparkSession, out_dir: str, schema: T.StructType, versions: Sequence[int]) -> DataFrame:
    return spark.read.schema(schema).option("basePath", f"{out_dir.rstrip('/')}/items").parquet(
        *[version_path(out_dir, v, "items") for v in versions])


def ingest_batch(batch: DataFrame, batch_id: int, out_dir: str, keys: Sequence[str], ordinal: Sequence[str],
                 transform=None) -> None:
    """Process the items of one increment that have not been processed before; of an item that comes several
    times in it, the row of least ``ordinal``.  An item that ``transform`` drops stays open."""
    spark = batch.sparkSession
    first = batch.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(
        F.min_by(F.struct(*batch.columns), F.struct(*ordinal)).alias("__r")).select("__r.*").withColumn("bucket", bucket_of(keys))
    done = _versions(spark, out_dir, "items", below=batch_id)
    if done:
        fields = T.StructType([*[batch.schema[k] for k in keys], T.StructField("bucket", T.IntegerType())])
        seen = _items(spark, out_dir, fields, done)
        touched = F.broadcast(first.select("bucket").distinct())  # at most BUCKETS rows
        seen = seen.join(touched, "bucket", "left_semi").select(*[F.col(k).alias(f"__{k}") for k in keys])
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
        first = first.join(seen, same, "left_anti")
    out = first if transform is None else transform(first)
    out.write.mode("overwrite").partitionBy("bucket").parquet(version_path(out_dir, batch_id, "items"))


def incremental_ingest(spark: SparkSession, source_dir: str, schema: T.StructType, out_dir: str, checkpoint: str,
                       keys: Sequence[str], ordinal: Sequence[str] | None = None, transform=None) -> None:
    """Process every item (row of a key) of the files once, also if it comes again in a later file.  ``ordinal``
    (default: all other columns) says which of several rows in one increment counts.  ``transform`` maps rows to
    rows and keeps the keys and ``bucket``."""
    order = list(ordinal or [f.name for f in schema.fields if f.name not in keys])

    def ingest(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, batch_id, out_dir, keys, order, transform)

    _drained(spark.readStream.schema(schema).parquet(source_dir), ingest, checkpoint)


def ingested(spark: SparkSession, out_dir: str, schema: T.StructType) -> DataFrame:
    """All processed items."""
    versions = _versions(spark, out_dir, "items")
    if not versions:
        return spark.createDataFrame([], schema)
    return _items(spark, out_dir, schema, versions).select(*[f.name for f in schema.fields])
