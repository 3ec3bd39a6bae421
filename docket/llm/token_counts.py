"""Token counts without token ids.

The pieces of a pre-token are counted once per distinct pre-token of the corpus. Per-document
frequencies are joined to those counts and summed. Pre-tokens at or above a frequency, the lowest
power of two that leaves at most ``HOT`` of them, are summed where the document is read (their
table is bounded, so it goes to every worker); the others, a few per document, meet their counts
in a shuffled join. So neither a hot word nor a large vocabulary lands in one task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docket.llm.common import stored, texts
from docket.llm.pretokens import pretokens

#: Most frequent pre-tokens that every worker may hold.
HOT = 100_000
#: Distinct pre-tokens that a task combines before it passes them on.
COMBINED = 300_000


def _pairs(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"piece": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})


def vocabulary(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(piece, n, tokens): each distinct pre-token, how often it occurs, how many tokens it has."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, counts = pretokens(tokenizer), Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update(coder.parts(text))
                if len(counts) >= COMBINED:
                    yield _pairs(counts)
                    counts = Counter()
        yield _pairs(counts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pretokens(tokenizer)
        for batch in batches:
            sizes = coder.sizes(batch.column("piece").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64())], ["piece", "n", "tokens"])

    pieces = docs.select("text").mapInArrow(combine, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return pieces.mapInArrow(count, "piece string, n long, tokens long")


def hottest(words: DataFrame, most: int) -> dict[str, int]:
    """The tokens of the pre-tokens at or above the lowest power of two that leaves at most ``most``."""
    power = F.floor(F.log2("n")).cast("int")
    left, least = most, 64
    for r in words.groupBy(power.alias("p")).count().orderBy(F.desc("p")).collect():  # at most 64 rows
        left -= r["count"]
        if left < 0:
            break
        least = r["p"]
    return {r.piece: r.tokens for r in words.filter(F.floor(F.log2("n")) >= least).select("piece", "tokens").collect()}


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text",
                 hot: int = HOT) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    The counts are those of the tokenizers library without added special tokens; the strings of
    special tokens inside a text are one token, as the library has it. Null text: 0 bytes, 0
    tokens. Null and repeated ids and repeated rows each give their own row. An empty table gives
    no rows.
    """
    rows = texts(docs, id_col, text_col)
    words = stored(vocabulary(rows, tokenizer), "pretokens")
    known = docs.sparkSession.sparkContext.broadcast(hottest(words, hot))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sizes = pretokens(tokenizer), known.value
        for batch in batches:
            at, pieces, ns, base = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                total = 0
                for piece, n in Counter(coder.parts(text)).items():
                    size = sizes.get(piece)
                    if size is None:
                        at.append(i)
                        pieces.append(piece)
                        ns.append(n)
                    else:
                        total += n * size
                base.append(total)
            rest = len(at)
            at = pa.array([*at, *range(batch.num_rows)], pa.int32())
            yield pa.RecordBatch.from_pydict({
                "row": batch.column("row").take(at), "doc_id": batch.column("doc_id").take(at),
                "n_bytes": batch.column("n_bytes").take(at),
                "rare": pa.array([True] * rest + [False] * batch.num_rows),
                "piece": pa.array([*pieces, *[""] * batch.num_rows], pa.string()),
                "n": pa.array([*ns, *base], pa.int64())})

    # the row number keeps repeated rows apart; it follows from the scan's order, so a task run again gives the same
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    pairs = numbered.mapInArrow(frequencies, "row long, doc_id long, n_bytes long, rare boolean, piece string, n long")
    # rows of known totals join nothing; the row number spreads them over the tasks
    keyed = pairs.withColumn("spread", F.when(F.col("rare"), F.lit(-1)).otherwise(F.col("row")))
    counts = words.select("piece", "tokens", F.lit(-1).cast("long").alias("spread"))
    return (
        keyed.join(counts, ["piece", "spread"], "left")
        .groupBy("row", "doc_id", "n_bytes")
        .agg(F.sum(F.when(F.col("rare"), F.col("n") * F.col("tokens")).otherwise(F.col("n"))).alias("n_tokens"))
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
