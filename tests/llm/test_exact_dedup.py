import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from docket.llm.exact_dedup import exact_dedup


def brute(rows):
    norm = [(r.doc_id, re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in rows]
    groups = defaultdict(list)
    for d, t in norm:
        groups[t].append(d)
    out = []
    for t, ids in groups.items():
        known = [d for d in ids if d is not None]
        keep, done = min(known) if known else None, False
        for d in sorted(ids, key=lambda d: (d is None, d or 0)):
            kept = not done and d == keep
            done |= kept
            out.append((d, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_odd_rows(odd_docs):
    assert got(exact_dedup(odd_docs)) == brute(odd_docs.collect())


def test_digest_collisions_are_told_apart_by_content(odd_docs):
    weak = got(exact_dedup(odd_docs, digest=lambda t: F.substring(F.sha2(t, 256), 1, 1)))
    assert [r[:4] for r in weak] == [r[:4] for r in sorted(got(exact_dedup(odd_docs)), key=lambda r: repr(r[:4]))]


def test_hot_group_and_empty_table(spark):
    hot = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
        F.concat(F.lit("t"), F.col("id"))).alias("text"))
    rows = got(exact_dedup(hot))
    assert rows == brute(hot.collect())
    assert exact_dedup(hot.limit(0)).count() == 0
