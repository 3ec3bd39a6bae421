"""Conversation structure repair: turns aligned to strings of the grammar ``(s?(ua)+)?``.

An edit script turns a conversation's rows into role initials that the grammar has. For every length
there is one string, and the strings of all lengths share their endings, so one Wagner-Fischer
table, filled from the last row, holds the cost of aligning the rows that are left with the last j
characters of every feasible length. A repair found by one greedy pass is the incumbent: cells so
far off the diagonal that their deletions or insertions alone cost more (Ukkonen's band) are not
kept, and lengths above it are not feasible. The cheapest lengths are traced back, each taking the
ASCII-least letter that stays cheapest, and their audits are compared.

Rows are sorted over the whole table, so a conversation with a third of all rows lies in many
partitions. It is cut into blocks of at most ``BLOCK`` rows. A block's table gives the cost from
each state of the grammar (nothing yet, after the system turn, after an assistant, after a user) to
each; these 16 numbers are chained along the conversation, which gives every block the costs of
what follows, and the blocks are then traced back apart from each other. Only the digest of the
repaired text, one value over the whole conversation by definition, is a stream through one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docket.llm.common import shuffle_parts, stored

#: Rows of a block, at most.
BLOCK = 1024
#: Costs of the edits, and of a truncated row that is not deleted.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States of the grammar: nothing yet, after s, after a (u comes next), after u (a comes next).
START, SYSTEM, USER_NEXT, ASSISTANT_NEXT = range(4)
_NEVER = 1 << 40


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) damaged by crc32(``conv_id:turn``) % 20, nulls as one space:
    0 drops the row (``live`` is false), 1 empties its text, 2 removes its ``.``, ``!`` and ``?``,
    3 repeats it, 4 sets its role to user."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    kind = F.crc32(key) % 20
    return rows.select(
        "conv_id", "turn", (kind != 0).alias("live"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


class Alignment:
    """The edit tables of one block.

    ``initials``: a character per row, ``faults``: d (must be deleted), t (truncated) or a blank.
    ``tail`` (by state, after the block): cost of the rest of the conversation. The last block's
    scripts may end with insertions; other blocks leave them to the next row's block.
    """

    def __init__(self, initials: str, faults: str, tail: list[int], last: bool, entries=(START,)):
        self.n, self.tail, self.last = len(initials), tail, last
        code = np.frombuffer(initials.encode("utf-32-le", "surrogatepass"), np.uint32)
        doomed = np.array([f == "d" for f in faults], bool)
        late = np.array([TRUNCATED if f == "t" else 0 for f in faults], np.int64)
        #: cost of standing for 'u' (column 0), 'a' (1) and 's' (2)
        self.stand = np.stack([np.where(doomed, _NEVER, late + np.where(code == ord("u"), 0, REROLE)),
                               np.where(doomed, _NEVER, late + np.where(code == ord("a"), 0, REROLE)),
                               np.where(doomed | (code != ord("s")), _NEVER, late)])
        self.fits = np.stack([code == ord("u"), code == ord("a")])
        most = max(self._incumbent(state) for state in entries)
        self.low, high = min(self.n, most // DELETE), most // INSERT
        self.width = self.low + high + 1
        self.tables = {exit: self._table(exit) for exit in ((USER_NEXT,) if last else (USER_NEXT, ASSISTANT_NEXT))}

    def _incumbent(self, state: int) -> int:
        """The cost of one repair to the end, or a bound of every cheapest path through the block."""
        bound = DELETE * self.n + 2 * INSERT
        if not self.last:
            return bound
        total, at = 0, state
        for i in range(self.n):
            want = 1 if at == ASSISTANT_NEXT else 0
            if at == START and self.stand[2][i] == 0:
                at = SYSTEM
            elif self.stand[want][i] < DELETE:
                total += int(self.stand[want][i])
                at = USER_NEXT if want else ASSISTANT_NEXT
            else:
                total += DELETE
        return min(bound, total + {START: 0, USER_NEXT: 0, ASSISTANT_NEXT: INSERT, SYSTEM: 2 * INSERT}[at])

    def _table(self, exit: int) -> np.ndarray:
        """[row, k]: cost of aligning the rows from there with the last j characters, j = rows left + k - low."""
        n, k = self.n, np.arange(self.width)
        table = np.full((n + 1, self.width), _NEVER, np.int64)
        j = k - self.low
        if self.last:
            table[n][j >= 0] = INSERT * j[j >= 0]
        else:
            table[n][j == 0] = 0
        steps = INSERT * k
        for i in range(n - 1, -1, -1):
            j = j + 1  # one more row is left
            after = table[i + 1]
            wants = (j & 1) ^ (exit == ASSISTANT_NEXT)  # 1: the j-th character from the end is 'a'
            row = after + self.stand[wants, i]
            row[:-1] = np.minimum(row[:-1], after[1:] + DELETE)
            row = np.minimum.accumulate(row - steps) + steps
            row[j < 0] = _NEVER
            table[i] = np.minimum(row, _NEVER)
        return table

    def cost(self, exit: int, i: int, j: int) -> int:
        k = j - (self.n - i) + self.low
        return int(self.tables[exit][i, k]) if 0 <= k < self.width and j >= 0 else _NEVER

    def _plain(self, entry: int, i: int) -> Iterator[tuple[int, int, int, int]]:
        """(cost without the rest, exit state, table, length) from row ``i`` on without a system turn."""
        for exit, table in self.tables.items():
            # lengths that lead from the entry's state to this exit; length 0 changes nothing
            odd = (entry == ASSISTANT_NEXT) != (exit == ASSISTANT_NEXT)
            first = self.n - i - self.low
            lengths = np.arange(max(first, 1), self.n - i + self.width - self.low)
            lengths = lengths[(lengths & 1) == odd]
            costs = table[i, lengths - first]
            for j in lengths[costs <= costs.min(initial=_NEVER - 1)].tolist():
                yield self.cost(exit, i, j), exit, exit, j
        exit = next(iter(self.tables))
        if self.cost(exit, i, 0) < _NEVER:
            yield self.cost(exit, i, 0), entry, exit, 0

    def paths(self, entry: int) -> Iterator[tuple[int, int, int, int, int]]:
        """(cost without the rest, exit state, row of the system turn or -1, table, length of what follows)."""
        for cost, exit, table, j in self._plain(entry, 0):
            yield cost, exit, -1, table, j
        if entry == START:
            for p in np.flatnonzero(self.stand[2] < _NEVER).tolist():
                head = DELETE * p + int(self.stand[2][p])
                for cost, exit, table, j in self._plain(SYSTEM, p + 1):
                    yield head + cost, exit, p, table, j

    def cheapest(self, entry: int) -> list[int]:
        """The least cost from the entry's state to every state, without the rest."""
        best = [_NEVER] * 4
        for cost, exit, *_ in self.paths(entry):
            best[exit] = min(best[exit], cost)
        return best

    def _trace(self, i: int, j: int, exit: int) -> str:
        out, now = [], self.cost(exit, i, j)
        while i < self.n or j > 0:
            want = (j & 1) ^ (exit == ASSISTANT_NEXT)
            if i < self.n and now == DELETE + self.cost(exit, i + 1, j):
                out.append("D")
                i += 1
            elif j > 0 and now == INSERT + self.cost(exit, i, j - 1):
                out.append("I")
                j -= 1
            else:
                out.append("K" if self.fits[want, i] else "R")
                i, j = i + 1, j - 1
            now = self.cost(exit, i, j)
        return "".join(out)

    def repair(self, entry: int) -> tuple[int, str, int]:
        """(cost with the rest, ASCII-least audit of the block, exit state); cost ``_NEVER`` if there is none."""
        found = [(cost + self.tail[exit], exit, p, table, j) for cost, exit, p, table, j in self.paths(entry)]
        least = min((x[0] for x in found), default=_NEVER)
        if least >= _NEVER:
            return _NEVER, "", entry
        audits = []
        for cost, exit, p, table, j in found:
            if cost == least:
                head = "D" * p + "K" if p >= 0 else ""
                audits.append((head + self._trace(p + 1, j, table), exit))
        audit, exit = min(audits)
        return least, audit, exit


#: After the last row: the grammar may end at the start and after an assistant.
_END = [0, _NEVER, 0, _NEVER]

_BLOCK = ("conv_id {id}, at long, whole boolean, initials string, faults string, blank long, duplicate long, truncated long, "
          "illegal long, cost long, audit string, costs array<array<long>>")


def _illegal(initials: str) -> int:
    return sum(initials[i:i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))


def _blocks(schema: pa.Schema):
    """One row per conversation and block. Inside a block all but its first and last conversation are
    whole, so they are repaired at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rows in batch.column("rows").to_pylist():
                parts = [(conv, list(part)) for conv, part in groupby(rows, key=lambda r: r["conv_id"])]
                for i, (conv, part) in enumerate(parts):
                    initials, faults = "".join(r["initial"] for r in part), "".join(r["fault"][0] for r in part)
                    codes = "".join("d" if f in "bd" else f for f in faults)
                    whole = 0 < i < len(parts) - 1
                    cost, audit, costs = None, None, None
                    if whole:
                        cost, audit, _ = Alignment(initials, codes, _END, True).repair(START)
                    else:
                        table = Alignment(initials, codes, [0] * 4, False, range(4))
                        costs = [table.cheapest(s) for s in range(4)]
                    out.append({"conv_id": conv, "at": part[0]["rid"], "whole": whole, "initials": initials, "faults": codes,
                                "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"),
                                "illegal": _illegal(initials), "cost": cost, "audit": audit, "costs": costs})
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _tails(schema: pa.Schema):
    """Chains the blocks of a conversation from the last one: (conv_id, at, last, tail), and the faults
    between neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                tail = _END
                blocks = row["blocks"]
                for i in range(len(blocks) - 1, -1, -1):
                    b = blocks[i]
                    last = i == len(blocks) - 1
                    seam = 0 if last else _illegal(b["to"] + blocks[i + 1]["of"])
                    out.append({"conv_id": row["conv_id"], "at": b["at"], "last": last, "tail": tail, "seam": seam})
                    if not last:
                        tail = [min(_NEVER, min(c + t for c, t in zip(costs, tail, strict=True))) for costs in b["costs"]]
                    else:
                        tail = b["ends"]
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cost from each state through the block to the conversation's end, for a block that may be the last."""
    for batch in batches:
        ends = []
        for initials, faults in zip(batch.column("initials").to_pylist(), batch.column("faults").to_pylist(), strict=True):
            table = Alignment(initials, faults, _END, True, range(4))
            ends.append([table.repair(s)[0] for s in range(4)])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends, pa.list_(pa.int64()))], [*batch.schema.names, "ends"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each block does from each entry state: (cost with the rest, audit, exit)."""
    kind = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string()), ("exit", pa.int32())]))
    for batch in batches:
        pieces = []
        for row in batch.select(["initials", "faults", "tail", "last"]).to_pylist():
            table = Alignment(row["initials"], row["faults"], row["tail"], row["last"], range(4))
            pieces.append([dict(zip(("cost", "audit", "exit"), table.repair(s), strict=True)) for s in range(4)])
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("at"), pa.array(pieces, kind)], ["conv_id", "at", "pieces"])


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Follows the states through the blocks of a conversation."""
    for batch in batches:
        costs, audits = [], []
        for blocks in batch.column("blocks").to_pylist():
            state, audit = START, []
            for b in blocks:
                piece = b["pieces"][state]
                audit.append(piece["audit"])
                state = piece["exit"]
            costs.append(blocks[0]["pieces"][START]["cost"])
            audits.append("".join(audit))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(costs, pa.int64()), pa.array(audits, pa.string())],
                                         ["conv_id", "cost", "audit"])


class _Repaired:
    """The digest of a repaired conversation, fed row by row in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.sha, self.lines = audit, 0, hashlib.sha256(), 0
        kept = len(audit) - audit.count("D")
        self.next = -1 if kept % 2 else 0  # an odd length starts with the system turn

    def _line(self, role: str | None, text: str) -> None:
        wanted = "assistant" if self.next == 1 else "user"
        line = f"{wanted if role is None else role}:{text}"
        self.sha.update((("\n" if self.lines else "") + line).encode("utf-8", "surrogatepass"))
        self.lines += 1
        self.next = 1 if self.next == 0 else 0

    def inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._line(None, "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit != "D":
            self._line(role if edit == "K" else None, text)

    def digest(self) -> str:
        self.inserted()
        return self.sha.hexdigest()


def _digests(schema: pa.Schema):
    """Streams rows sorted by (conv_id, rid); each conversation's first row has its audit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, conv, audit = None, None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["audit"] is not None:
                    if now is not None:
                        out.append({"conv_id": conv, "audit": audit, "repaired_sha256": now.digest()})
                    conv, audit, now = row["conv_id"], row["audit"], _Repaired(row["audit"])
                else:
                    now.row(row["role"], row["text"])
            yield pa.RecordBatch.from_pylist(out, schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "audit": audit, "repaired_sha256": now.digest()}], schema)

    return run


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def _initial(role: Column) -> Column:
    # an empty role, like any letter but s, u and a, is no part of the grammar
    return F.when(role == "", " ").otherwise(F.substring(role, 1, 1))


def repair(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per distinct conv_id of the damaged table: conv_id, gaps, blank, duplicate, truncated, illegal, cost
    (longs), audit, repaired_sha256.

    ``conversations`` has conv_id, live, turn, role, text (see ``damaged``); rows that are not live only
    give their conv_id. Rows stand by turn (nulls first); rows of one turn by role, then by their
    text's digest, equal rows beside each other. A null conv_id is a conversation of its own. An
    empty or unknown role fits no place of the grammar and must be reroled or deleted. A conversation
    without live rows has zeros, an empty audit and the digest of the empty string. Texts of any
    length are streamed. An empty table gives no rows. Extra columns are left out.
    """
    spark = conversations.sparkSession
    id_type = conversations.schema["conv_id"].dataType.simpleString()
    rows = conversations.select("conv_id", "turn", "live", "role", "text").withColumn("digest", F.sha2("text", 256))
    # the running number deals equal rows to several partitions, too
    keyed = rows.filter("live").withColumn("salt", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "role", "digest", "salt"]
    end = F.rtrim(F.col("text"), F.lit(" \t\n\v\f\r"))
    ordered = stored(
        keyed.repartitionByRange(*order).sortWithinPartitions(*order).select(
            F.monotonically_increasing_id().alias("rid"), "conv_id", "turn", "role", "text", "digest",
            _initial(F.col("role")).alias("initial"),
            F.when(end == "", "blank").when(~F.substring(end, -1, 1).isin(".", "!", "?"), "truncated")
            .otherwise(" ").alias("fault")),
        "turns")

    firsts = ordered.filter("fault <> 'blank'").groupBy("conv_id", "role", "digest").agg(F.min("rid").alias("rid")).select(
        "rid", F.lit(True).alias("first"))
    faults = ordered.select("rid", "conv_id", "initial", "fault").join(firsts, "rid", "left").select(
        "rid", "conv_id", "initial",
        F.when((F.col("fault") != "blank") & F.col("first").isNull(), "duplicate").otherwise(F.col("fault")).alias("fault"))
    # rows of one partition stand in order; a bucket is a run of them
    bucket = (F.shiftright("rid", 33).alias("p"), F.floor(F.col("rid").bitwiseAND((1 << 33) - 1) / block).alias("b"))
    # a bucket is few bytes and much work, so buckets are dealt to a stated number of tasks
    buckets = faults.select("*", *bucket).repartition(shuffle_parts(spark), "p", "b").groupBy("p", "b").agg(
        F.sort_array(F.collect_list(F.struct("rid", "conv_id", "initial", "fault"))).alias("rows")).select("rows")

    ddl = _BLOCK.format(id=id_type)
    blocks = stored(buckets.mapInArrow(_blocks(_arrow(ddl)), ddl), "turn-blocks")

    open_ = blocks.filter("not whole")
    chain_ddl = f"conv_id {id_type}, at long, last boolean, tail array<long>, seam long"
    # only a conversation's last block needs its costs to the end
    ended = open_.groupBy("conv_id").agg(F.max("at").alias("at"))
    lasts = open_.join(ended.select("at"), "at").select("at", "initials", "faults").mapInArrow(
        _ends, "at long, initials string, faults string, ends array<long>").select("at", "ends")
    chained = open_.join(lasts, "at", "left").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        "at", "costs", "ends", F.substring("initials", 1, 1).alias("of"), F.substring("initials", -1, 1).alias("to")))).alias("blocks"))
    tails = stored(chained.mapInArrow(_tails(_arrow(chain_ddl)), chain_ddl), "turn-tails")

    pieces = open_.select("conv_id", "at", "initials", "faults").join(tails.drop("conv_id"), "at").mapInArrow(
        _pieces, f"conv_id {id_type}, at long, pieces array<struct<cost:long,audit:string,exit:int>>")
    cut = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "pieces"))).alias("blocks")).mapInArrow(
        _chosen, f"conv_id {id_type}, cost long, audit string")
    audits = stored(blocks.filter("whole").select("conv_id", "cost", "audit").unionByName(cut), "turn-audits")

    digest_ddl = f"conv_id {id_type}, audit string, repaired_sha256 string"
    lines = ordered.select("conv_id", "rid", "role", "text", F.lit(None).cast("string").alias("audit")).unionByName(
        audits.select("conv_id", F.lit(-1).cast("long").alias("rid"), F.lit(None).cast("string").alias("role"),
                      F.lit(None).cast("string").alias("text"), "audit"))
    digests = lines.repartition("conv_id").sortWithinPartitions("conv_id", "rid").mapInArrow(_digests(_arrow(digest_ddl)), digest_ddl)

    counts = blocks.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")))
    seams = tails.groupBy("conv_id").agg(F.sum("seam").alias("seam"))
    turns = rows.groupBy("conv_id", "turn").agg(F.max("live").alias("live")).groupBy("conv_id").agg(
        *(f(F.when(F.col("live"), F.col("turn"))).alias(name) for f, name in ((F.min, "low"), (F.max, "high"), (F.count, "n"))))
    out = turns
    for part, columns in ((counts, ["blank", "duplicate", "truncated", "illegal"]), (seams, ["seam"]),
                          (audits.select("conv_id", "cost"), ["cost"]), (digests, ["audit", "repaired_sha256"])):
        out = out.join(part.withColumnRenamed("conv_id", "_id"), F.col("conv_id").eqNullSafe(F.col("_id")), "left").select(
            *out.columns, *columns)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(
        "conv_id", zero(F.col("high") - F.col("low") + 1 - F.col("n")).alias("gaps"),
        *(zero(F.col(c)).alias(c) for c in ("blank", "duplicate", "truncated")),
        (zero(F.col("illegal")) + zero(F.col("seam"))).alias("illegal"), zero(F.col("cost")).alias("cost"),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
