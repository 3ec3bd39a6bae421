"""Tokenisation, padding and the token-store joins.

The original loads a pretrained subword vocabulary; here the vocabulary is
built from the corpus (re-aimed) and holds every token.  It grows with the
data, so ids come from a distributed rank.  Of the vocabulary the frequent tokens,
as many as a checked size allows, are looked up where the text is split (JVM-side),
a list at a time; rows of the others meet their ids in a shuffle.  A document's
list is bounded by ``max_length``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docket.functions import arrays as A
from docket.functions import strings as S
from docket.operators.splits import global_rank

# Special token ids.
PAD, UNK, CLS, SEP = 0, 1, 2, 3
N_SPECIAL = 4
#: Bytes of a vocabulary that may go to every executor.
BROADCAST_BYTES = 32 << 20
TOKEN_RE = r"[\p{L}\p{N}_]+"


def word_tokens(text: Column) -> Column:
    """Lower-cased word tokens of the whole text."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_RE), 0)


def build_vocab(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All tokens of the corpus with their counts, ids from ``N_SPECIAL``
    upwards by falling count (ties by token).  Counting is a partial
    aggregate, the id a distributed rank."""
    counts = (docs.select(F.explode(word_tokens(F.col(text_col))).alias("token"))
              .groupBy("token").agg(F.count(F.lit(1)).alias("freq")))
    ranked = global_rank(counts, [F.col("freq").desc(), F.col("token").asc()])
    return ranked.select("token", "freq", (F.col("rn") - 1 + N_SPECIAL).cast("int").alias("id"))


def _first_apart(vocab: DataFrame, most: int) -> int | None:
    """The least power of two (less one) from which on ids do not fit into ``most`` bytes; None if all fit."""
    power = F.floor(F.log2(F.col("id") + 1)).cast("int")
    left = most
    for r in vocab.groupBy(power.alias("p")).agg(F.sum(F.octet_length("token") + 16).alias("size")).orderBy("p").collect():  # at most 32 rows
        left -= r["size"] or 0
        if left < 0:
            return (1 << r["p"]) - 1
    return None


def _held_ids(counted: DataFrame, held: DataFrame) -> DataFrame:
    """``counted`` with the list ``ids`` beside its tokens ``__t``, null where ``held`` (its size checked) lacks one."""
    table = counted.sparkSession.sparkContext.broadcast(held.select("token", "id").toArrow().combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, ids = (table.value.column(c).combine_chunks() for c in ("token", "id"))
        for batch in batches:
            lists = batch.column("__t")
            at = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy()))).astype(np.int32)
            found = ids.take(pc.index_in(lists.flatten().cast(tokens.type), value_set=tokens))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(at), found.cast(pa.int32()))], [*batch.schema.names, "ids"])

    return counted.mapInArrow(run, T.StructType([*counted.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def tokenize_encode(docs: DataFrame, key_col: str, text_col: str, vocab: DataFrame,
                    max_length: int = 512, most: int = BROADCAST_BYTES) -> DataFrame:
    """text → [CLS] ids… [SEP] truncated to ``max_length`` with a mask of 1s;
    unknown tokens → UNK.  The whole text is split and counted
    (``n_tokens``); positions past the truncation are dropped right after
    the split, so texts never move.  Ids rise with falling counts: the frequent
    tokens, as many as fit into ``most`` bytes, are looked up in place, and only
    (key, position, token) rows of the others meet their ids in a shuffle."""
    keep = max_length - 2
    toks = docs.select(F.col(key_col).alias("key"), word_tokens(F.col(text_col)).alias("__t"))
    counted = toks.select("key", F.size("__t").alias("n_tokens"), F.slice("__t", 1, keep).alias("__t"))
    vocab, apart = vocab.select("token", "id"), _first_apart(vocab, most)
    looked = _held_ids(counted, vocab if apart is None else vocab.filter(F.col("id") < apart))
    if apart is None:
        rows = looked.select("key", "n_tokens", F.transform("ids", lambda i: F.coalesce(i, F.lit(UNK))).alias("ids"),
                             F.lit(None).cast("struct<pos:int,id:int>").alias("other"))
    else:
        lacking = F.filter(F.transform("ids", lambda i, pos: F.struct(pos.alias("pos"), i.alias("id"))), lambda e: e["id"].isNull())
        far = looked.select("key", "n_tokens", F.explode(F.transform(lacking, lambda e: F.struct(
            e["pos"].alias("pos"), F.get("__t", e["pos"]).alias("token")))).alias("e")).select("key", "n_tokens", "e.*")
        far = far.join(vocab.filter(F.col("id") >= apart), "token", "left")
        rows = looked.select("key", "n_tokens", "ids", F.lit(None).cast("struct<pos:int,id:int>").alias("other")).unionByName(far.select(
            "key", "n_tokens", F.lit(None).cast("array<int>").alias("ids"), F.struct("pos", F.coalesce("id", F.lit(UNK)).alias("id")).alias("other")))
    per = rows.groupBy("key").agg(F.max("n_tokens").alias("n_tokens"), F.collect_list("ids").alias("__near"), F.collect_list("other").alias("__far"))
    # one text of the key: each gap takes its id; more texts: their ids by position
    one = F.when(F.size("__far") == 0, F.get("__near", F.lit(0))).otherwise(F.transform(F.get("__near", F.lit(0)), lambda i, pos: F.coalesce(
        i, F.get(F.filter("__far", lambda e: e["pos"] == pos), F.lit(0))["id"])))
    placed = F.flatten(F.transform("__near", lambda ids: F.transform(ids, lambda i, pos: F.struct(pos.alias("pos"), i.alias("id")))))
    several = A.in_order(F.concat(F.filter(placed, lambda e: e["id"].isNotNull()), F.col("__far")), "id")
    per = per.withColumn("__ids", F.when(F.size("__near") == 1, one).otherwise(several))
    ids = F.concat(F.array(F.lit(CLS)), F.col("__ids"), F.array(F.lit(SEP)))
    return per.select("key", "n_tokens", ids.alias("input_ids"),
                      F.array_repeat(F.lit(1), F.size(ids)).alias("attention_mask"))


def pad_and_mask(tok: DataFrame, batch_col: str, ids_col: str = "input_ids") -> DataFrame:
    """Pad every row to the longest row of its batch with PAD, mask 1/0.
    Batches are bounded, so the window over a batch is too."""
    width = F.max(F.size(ids_col)).over(Window.partitionBy(batch_col))
    return tok.withColumn("__w", width).select(
        "*", A.pad_to(F.col(ids_col), F.col("__w"), PAD).alias("padded_ids"),
        A.mask_of(F.col(ids_col), F.col("__w")).alias("padded_mask")).drop("__w")


def court_features(case_vec: DataFrame, member_vecs: DataFrame, case_key: str, ord_col: str, vec_col: str,
                   dim: int, max_members: int = 11) -> DataFrame:
    """Case vector followed by its first ``max_members`` member vectors (in
    ordinal order), zero-padded to ``max_members``; plus the real-member
    mask.  The per-case list is bounded by ``max_members``."""
    ranked = member_vecs.withColumn(
        "__k", F.row_number().over(Window.partitionBy(case_key).orderBy(ord_col)))
    firsts = ranked.filter(F.col("__k") <= max_members)
    per = firsts.groupBy(case_key).agg(
        A.in_order(F.collect_list(F.struct("__k", vec_col)), vec_col).alias("__m"))
    zero = F.array_repeat(F.lit(0.0), dim)
    j = case_vec.join(per, case_key, "left").withColumn("__m", F.coalesce("__m", F.array().cast("array<array<double>>")))
    padded = F.concat(F.col("__m"), F.array_repeat(zero, F.greatest(F.lit(max_members) - F.size("__m"), F.lit(0))))
    return j.select(case_key, F.concat(F.col(vec_col), F.flatten(padded)).alias("features"),
                    F.size("__m").alias("justice_count"),
                    A.mask_of(F.col("__m"), F.lit(max_members)).alias("justice_mask"))


def _by_basename(store: DataFrame, key_col: str) -> DataFrame:
    """One entry per file basename (the least key of equal ones): basename and token struct."""
    base = S.basename(S.normalize_path(F.col(key_col)))
    # side by side, so that a part that nobody reads does not move
    entry = [F.min_by(c, F.col(key_col)).alias(c) for c in ("input_ids", "attention_mask")]
    return store.groupBy(base.alias("__b")).agg(*entry).select("__b", F.struct("input_ids", "attention_mask").alias("tokens"))


def join_tokens_by_basename(records: DataFrame, bio_tokens: DataFrame, desc_tokens: DataFrame,
                            key_col: str = "key", with_bios: bool = True) -> tuple[DataFrame, DataFrame]:
    """Records ⋈ token stores on file basename (either separator).

    Returns (kept, skipped): kept rows have the case's description tokens
    (``case_tokens``) and ≥ 1 bio with tokens: ``members``, one token struct
    per bio in the record's order, ``justice_count`` of them.  Skipped rows
    carry the reason.  ``with_bios`` = False is the description-only variant.
    A record's bios are the members of one case.  As in the original, whose
    first look-up is the description's, only records with a description gather
    their members' tokens; of the skipped ones all count their bios with tokens.
    For the kept rows only records with a description are worked on: each goes with
    its first bio, meets the other bios' tokens per case, and last its own tokens."""
    dt = _by_basename(desc_tokens, key_col).select(F.col("__b").alias("__d"), F.col("tokens").alias("case_tokens"))
    # no basename holds a slash: records without a description match nothing, and do not all meet in one task
    alone = F.concat(F.lit("/"), F.col("case_id").cast("string"))
    r = records.withColumn("__db", F.coalesce(S.basename(S.normalize_path(F.col("description"))), alone))
    r = r.join(dt, F.col("__db") == F.col("__d"), "left").drop("__db", "__d")
    reason = (F.when(F.col("description").isNull(), F.lit("no description"))
              .when(F.col("case_tokens").isNull(), F.lit("description not tokenized")))
    if with_bios:
        found = (records.select("case_id", F.col("description").isNotNull().alias("__described"), F.posexplode("bios").alias("pos", "__p"))
                 .withColumn("__b", S.basename(S.normalize_path(F.col("__p"))))
                 .join(_by_basename(bio_tokens, key_col), "__b"))
        entry = F.when(F.col("__described"), F.struct("pos", "tokens"))
        members = found.groupBy("case_id").agg(F.count("tokens").alias("__n"), A.in_order(F.collect_list(entry), "tokens").alias("members"))
        r = r.join(members, "case_id", "left").withColumn("justice_count", F.coalesce("__n", F.lit(0).cast("long"))).drop("__n")
        reason = reason.when(F.col("justice_count") == 0, F.lit("no valid justice biographies found"))
    j = r.withColumn("reason", reason)
    kept = j.filter(F.col("reason").isNull()).drop("reason")
    if with_bios:
        bio = S.basename(S.normalize_path(F.col("__p")))
        first = F.when(F.coalesce("pos", F.lit(0)) == 0, F.struct(*records.columns))
        parts = (records.filter(F.col("description").isNotNull() & F.col("case_id").isNotNull())
                 .select(*records.columns, F.posexplode_outer("bios").alias("pos", "__p"))
                 .select("case_id", "pos", first.alias("__r"), F.coalesce(bio, F.concat(F.lit("/"), F.col("case_id").cast("string"))).alias("__b")))
        entry = F.when(F.col("tokens").isNotNull(), F.struct("pos", "tokens"))
        per = parts.join(_by_basename(bio_tokens, key_col), "__b", "left").groupBy("case_id").agg(
            A.in_order(F.collect_list(entry), "tokens").alias("members"), F.collect_list("__r").alias("__rows"))
        found = (per.filter(F.size("members") > 0).select(F.explode("__rows").alias("__r"), "members")
                 .withColumn("__db", S.basename(S.normalize_path(F.col("__r.description")))))
        kept = found.join(dt, F.col("__db") == F.col("__d")).select(
            "__r.*", "case_tokens", "members", F.size("members").cast("long").alias("justice_count")).select(*kept.columns)
    return kept, j.filter(F.col("reason").isNotNull())


def resolve_versioned_pair(trunc: DataFrame, full: DataFrame, key_col: str = "key") -> DataFrame:
    """Truncated name → full name: exact match first, else the canonical
    base (``.txt`` and a trailing ``_vN``/``-vN`` removed) + ``.txt``;
    unmatched rows are dropped."""
    f = full.select(F.col(key_col).alias("__f")).distinct()
    t = trunc.select(F.col(key_col).alias("trunc_key")).withColumn(
        "__base", F.concat(S.canonical_base(F.col("trunc_key")), F.lit(".txt")))
    exact = t.join(f, F.col("trunc_key") == F.col("__f"), "left").withColumnRenamed("__f", "__exact")
    f2 = f.withColumnRenamed("__f", "__viabase")
    both = exact.join(f2, F.col("__base") == F.col("__viabase"), "left")
    return (both.select("trunc_key", F.coalesce("__exact", "__viabase").alias("full_key"))
            .filter(F.col("full_key").isNotNull()))


def enrich_with_metadata(files: DataFrame, justices: DataFrame, key_col: str = "trunc_key") -> DataFrame:
    """File → (appointment year, nominating president) of the member named by
    the truncated file, its version suffix and ``.txt`` dropped, ``_`` →
    space; (NULL, NULL) if none."""
    j = justices.select(F.col("name").alias("__n"), S.year_from_text(F.col("appointment_date")).alias("year"),
                        F.col("nominated_by").alias("president"))
    return files.withColumn("__name", F.replace(S.canonical_base(F.col(key_col)), F.lit("_"), F.lit(" "))) \
        .join(j, F.col("__name") == F.col("__n"), "left").drop("__name", "__n")


def pretraining_pairs(pairs: DataFrame, trunc: DataFrame, full: DataFrame) -> DataFrame:
    """Resolved (trunc_key, full_key) pairs with the token structs ``trunc`` and ``full`` of both texts
    (n_tokens, input_ids, attention_mask), NULL where a store lacks the key."""
    def entry(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col("key").alias(f"__{name}"), F.struct("n_tokens", "input_ids", "attention_mask").alias(name))

    j = pairs.join(entry(trunc, "trunc"), F.col("trunc_key") == F.col("__trunc"), "left")
    return j.join(entry(full, "full"), F.col("full_key") == F.col("__full"), "left").drop("__trunc", "__full")
