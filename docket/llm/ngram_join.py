"""Near-duplicate join on word n-grams by vertical partitioning of their global order.

A document is the set of its hashed n-grams; documents with equal sets are one class. The global
order of n-grams puts rare ones first: n-grams outside the ``COMMON`` most frequent ones (counted
over all documents) by hash, then those by frequency. The order is cut into fragments:

* the rare end, a document's prefix, is as long as the similarity asks for: two sets that are
  similar enough share an n-gram of it. Classes meet where they share one (a bucket), and only
  pairs that the n-gram's places in both sets allow go on. Buckets of at most ``SMALL`` classes
  give all such pairs, larger ones the pairs with their pivot, the class of least place;
* ``FRAGMENTS`` cuts of the whole order: a class has a count per fragment, the lesser counts summed
  over the fragments bound a pair's overlap, and pairs below the needed overlap end there;
* n-grams themselves: pairs that are left are verified by exact overlap, the sets of a small group
  of connected candidates in one place, those of a large one pair by pair.

Verified links are contracted to components. Large buckets that still hold several components are
then compared, the classes outside the bucket's main component against all, in blocks of bounded
size; pairs that are in one component need no link. So no link between components is missed, and
thousands of near copies of one text do not become millions of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docket.llm.common import shuffle_parts, stored, texts
from docket.llm.components import components

#: N-grams whose frequency every worker knows, at most. More data changes the speed, not the result.
COMMON = 1 << 19
FRAGMENTS = 128
#: Classes in a bucket that gives all its pairs; rows on either side of a block of a larger one.
SMALL, BLOCK = 16, 1024
#: Tasks that the members of one large bucket are dealt to.
SALTS = 32
#: Classes of a candidate group that is verified in one place.
GROUP = 256
#: Bits of the table that tells which classes have a candidate; false hits only cost reading.
FILTER_BITS = 1 << 24
#: Classes that a task remembers as sent.
REMEMBERED = 500_000
#: N-gram instances that a task sorts at once when it counts frequencies.
SORTED = 1_000_000

_P = np.uint64(0x9E3779B97F4A7C15)


_RNG = np.random.default_rng(85)
#: Multipliers of a byte by its place in its word: the place's lowest ten bits, and the rest.
_NEAR, _FAR = (_RNG.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1) | np.uint64(1) for n in (1024, 4096))
_FAR[0] = 1  # a word hashes the same in texts with and without a longer one
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of every word (runs of other bytes than ASCII white space, A-Z lower-cased), in order."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    blank = _BLANK[b]
    first = ~blank
    first[1:] &= blank[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(b))
    place[starts[0]:] -= np.repeat(starts, np.diff(starts, append=len(b)))
    v = (b.astype(np.uint64) + np.uint64(1)) * _NEAR[place & 1023]
    if len(place) > 1024 and place.max() > 1023:
        v *= _FAR[(place >> 10) & 4095]
    v[blank] = 0
    return _mixed(np.add.reduceat(v, starts))


def grams(text: str, n: int) -> np.ndarray:
    """The sorted set of hashed word n-grams; of fewer words the whole sequence as one; of none, nothing."""
    h = word_hashes(text)
    if not len(h):
        return h
    m = min(n, len(h))
    s = np.full(len(h) - m + 1, m, np.uint64)
    for k in range(m):
        s = s * _P + h[k: len(h) - m + 1 + k]
    s = _mixed(s)
    s.sort()
    return s[np.concatenate([[True], s[1:] != s[:-1]])]


def class_of(g: np.ndarray, seed: int) -> tuple[int, int]:
    """Two 64-bit numbers of a set: the class, and a second one by which clashes are found."""
    from hashlib import blake2b

    d = blake2b(g.tobytes(), digest_size=16, salt=seed.to_bytes(8, "little")).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


class Order:
    """The global order: rank of n-grams, common ones last by frequency."""

    def __init__(self, keys: np.ndarray, codes: np.ndarray, bits: int):
        self.keys, self.codes, self.shift = keys, codes, np.uint64(64 - bits)

    def ranked(self, g: np.ndarray) -> np.ndarray:
        """``g`` (sorted by hash) in global order."""
        if not len(self.keys):
            return g
        k = g >> self.shift
        i = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        code = np.where(self.keys[i] == k, self.codes[i], 0)
        return g[np.argsort(code, kind="stable")]


def needed(a, b, percent: int):
    """The least overlap of similar sets of sizes a and b: 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def prefix(n, percent: int):
    """(as the smaller, as the larger set of a pair): n-grams of the rare end that must hold a shared one."""
    return n - needed(n, n, percent) + 1, n - (-(-percent * n // 100)) + 1


def fragment_counts(g: np.ndarray) -> np.ndarray:
    """N-grams per fragment (the order by hash, cut evenly), at most 65,535 each."""
    c = np.bincount((g >> np.uint64(57)).astype(np.int64), minlength=FRAGMENTS)
    return np.minimum(c, 65_535).astype("<u2")


def _profiles(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two, counts = [], [], [], []
            for text in batch.column("text").to_pylist():
                g = grams(text, words)
                a, b = class_of(g, seed)
                n.append(len(g))
                one.append(a)
                two.append(b)
                counts.append(fragment_counts(g).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(one, pa.int64()),
                                              pa.array(two, pa.int64()), pa.array(counts, pa.binary())],
                                             ["doc_id", "text_key", "n", "class", "check", "counts"])

    return run


def _instances(words: int, bucket_bits: int):
    """Rows (bucket, keys): sorted n-gram instances of many documents as differences of 32-bit keys,
    stored by byte planes so that small differences compress."""
    shift = np.uint64(64 - 32 - bucket_bits)

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.concatenate(held)
        held.clear()
        keys >>= shift
        keys.sort()
        bucket, rest = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype("<u4")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(bucket) > 0]))
        rows = []
        for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
            step = np.diff(rest[a:b], prepend=np.zeros(1, "<u4")).astype("<u4")
            rows.append(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 4).T).tobytes())
        return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[starts], pa.int32()), "keys": pa.array(rows, pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                g = grams(text, words)
                same = hash(g.tobytes())
                if same in seen or not len(g):
                    continue  # one more copy of a text of this task
                seen.add(same)
                held.append(g)
                size += len(g)
                if size >= SORTED:
                    yield packed(held)
                    held, size, seen = [], 0, set()
        if held:
            yield packed(held)

    return run


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, df) of n-grams in four documents or more, from the rows of whole buckets in a row."""

    def counted(bucket: int, held: list[np.ndarray]) -> pa.RecordBatch:
        keys, df = np.unique(np.concatenate(held), return_counts=True)
        keys, df = keys[df >= 4].astype(np.int64) | bucket << 32, df[df >= 4]
        return pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "df": pa.array(df, pa.int64())})

    at, held = None, []
    for batch in batches:
        for bucket, planes in zip(batch.column("bucket").to_pylist(), batch.column("keys").to_pylist(), strict=True):
            if bucket != at and held:
                yield counted(at, held)
                held = []
            at = bucket
            step = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()
            held.append(np.cumsum(step, dtype=np.uint32))
    if held:
        yield counted(at, held)


def global_order(rows: DataFrame, words: int, common: int = COMMON) -> Order:
    """Counts all n-grams and keeps the most frequent: those from the least power of sqrt(2) on that leaves at most ``common``."""
    spark = rows.sparkSession
    n = shuffle_parts(spark)
    bits = max(6, (2 * n - 1).bit_length())
    counted = stored(rows.select("text").mapInArrow(_instances(words, bits), "bucket int, keys binary")
                     .repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_frequent, "key long, df long")
                     .withColumn("code", F.floor(2 * F.log2("df")).cast("int")), "ngram-counts")
    left, least = common, 1 << 10
    for r in counted.groupBy("code").count().orderBy(F.desc("code")).collect():  # at most 126 rows
        left -= r["count"]
        if left < 0:
            break
        least = r["code"]
    got = counted.filter(F.col("code") >= least).select("key", "code").toArrow()  # at most ``common`` rows
    keys = got.column("key").to_numpy().astype(np.uint64)
    order = np.argsort(keys)
    return Order(keys[order], got.column("code").to_numpy().astype(np.uint8)[order], 32 + bits)


def _entries(words: int, percent: int, seed: int, shared):
    """Rows (key, k, n, class): the n-gram at place k of a class's prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = shared.value, set()
        for batch in batches:
            keys, places, sizes, classes = [], [], [], []
            for text in batch.column("text").to_pylist():
                g = grams(text, words)
                if not len(g):
                    continue
                c, _ = class_of(g, seed)
                if c in seen:
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(c)
                p = order.ranked(g)[: prefix(len(g), percent)[1]]
                keys.append(p)
                places.append(np.arange(len(p), dtype=np.int32))
                sizes.append(np.full(len(p), len(g), np.int32))
                classes.append(np.full(len(p), c, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(places)),
                                                  pa.array(np.concatenate(sizes)), pa.array(np.concatenate(classes))], ["key", "k", "n", "class"])

    return run


def _feasible(k, n, c, k2, n2, c2, percent: int):
    """Whether the shared n-gram's places allow a similar pair (elementwise); c, c2 are class numbers."""
    first = (n < n2) | ((n == n2) & (c < c2))
    ns, nl, ks, kl = np.where(first, n, n2), np.where(first, n2, n), np.where(first, k, k2), np.where(first, k2, k)
    return ((100 * ns >= percent * nl) & (ks < prefix(ns, percent)[0]) & (kl < prefix(nl, percent)[1])
            & (1 + np.minimum(ns - ks, nl - kl) - 1 >= needed(ns, nl, percent)))


def _meet(percent: int):
    """From entries sorted by key, place, size and class: candidate pairs (key null), and the
    members of buckets above ``SMALL`` (key set; ``a`` the class, ``b`` null, place and size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.zeros((0, 4), np.int64)
        hot: tuple[int, np.ndarray] | None = None  # key and pivot of a large bucket under way

        def block(rows: np.ndarray, last: bool):
            nonlocal tail, hot
            keep = np.ones(len(rows), bool)
            keep[1:] = (np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 3]) != 0)  # copies of a class are adjacent
            rows = rows[keep]
            starts = np.flatnonzero(np.concatenate([[True], np.diff(rows[:, 0]) != 0])) if len(rows) else np.zeros(0, np.int64)
            ends = np.append(starts[1:], len(rows))
            out_pairs, out_hot = [], []
            tail = np.zeros((0, 4), np.int64)
            visit = ends - starts > 1
            if len(starts):
                visit[0] |= hot is not None and rows[0, 0] == hot[0]  # the rest of a large bucket, be it one row
                visit[-1] = True
            for s, e in zip(starts[visit].tolist(), ends[visit].tolist(), strict=True):
                yield_group(rows[s:e], last or e < len(rows), out_pairs, out_hot)
            pairs = np.concatenate(out_pairs) if out_pairs else np.zeros((0, 2), np.int64)
            big = np.concatenate(out_hot) if out_hot else np.zeros((0, 4), np.int64)
            n, m = len(pairs), len(big)
            none = np.concatenate([np.ones(n, bool), np.zeros(m, bool)])
            col = lambda x, mask=None: pa.array(x, pa.int64(), mask=mask)
            return pa.RecordBatch.from_arrays([
                col(np.concatenate([np.zeros(n, np.int64), big[:, 0]]), none), col(np.concatenate([pairs[:, 0], big[:, 3]])),
                col(np.concatenate([pairs[:, 1], np.zeros(m, np.int64)]), ~none), col(np.concatenate([np.zeros(n, np.int64), big[:, 1]]), none),
                col(np.concatenate([np.zeros(n, np.int64), big[:, 2]]), none)], ["key", "a", "b", "k", "n"])

        def yield_group(g: np.ndarray, whole: bool, out_pairs: list, out_hot: list):
            nonlocal tail, hot
            going = hot is not None and hot[0] == g[0, 0]
            if not going and not whole and len(g) <= SMALL:
                tail = g  # may go on in the next batch
                return
            if going or len(g) > SMALL:
                pivot = hot[1] if going else g[0]
                others = g if going else g[1:]
                ok = _feasible(pivot[1], pivot[2], pivot[3], others[:, 1], others[:, 2], others[:, 3], percent)
                out_pairs.append(np.stack([np.minimum(pivot[3], others[ok, 3]), np.maximum(pivot[3], others[ok, 3])], 1))
                out_hot.append(g)
                hot = (int(g[0, 0]), pivot) if not whole else None
                return
            i, j = np.triu_indices(len(g), 1)
            ok = _feasible(g[i, 1], g[i, 2], g[i, 3], g[j, 1], g[j, 2], g[j, 3], percent)
            a, b = g[i[ok], 3], g[j[ok], 3]
            out_pairs.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))

        for batch in batches:
            if batch.num_rows:
                rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "k", "n", "class")], 1)
                if hot is not None and rows[0, 0] != hot[0]:
                    hot = None
                yield block(np.concatenate([tail, rows]), False)
        if len(tail):
            yield block(tail, True)

    return run


def _sets(words: int, seed: int, shared):
    """(class, grams) of classes in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = shared.value, set()
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                g = grams(text, words)
                if not len(g):
                    continue
                c, _ = class_of(g, seed)
                at = c & (FILTER_BITS - 1)
                if wanted[at >> 3] >> (at & 7) & 1 and c not in seen:
                    if len(seen) < REMEMBERED:
                        seen.add(c)
                    out.append((c, g.tobytes()))
            cols = list(zip(*out, strict=True)) or [()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary())], ["class", "grams"])

    return run


def _filter(classes: DataFrame) -> bytes:
    """A bit table of the classes' lowest bits: its size is fixed, each task sends only its set bytes."""
    slot = F.pmod("class", F.lit(FILTER_BITS))
    rows = classes.groupBy(F.floor(slot / 8).cast("int").alias("at")).agg(
        F.bit_or(F.expr(f"shiftleft(1, cast(pmod(class, {FILTER_BITS}) % 8 as int))")).alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS // 8, np.uint8)
    table[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint8)
    return table.tobytes()


def _bounded(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, bound) whose fragment counts allow the needed overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, FRAGMENTS).astype(np.int32) for c in ("x", "y"))
            nx, ny = batch.column("nx").to_numpy(), batch.column("ny").to_numpy()
            # a fragment at the top of its range says nothing
            bound = np.where((x == 65_535) | (y == 65_535), np.minimum(nx, ny)[:, None], np.minimum(x, y)).sum(1)
            keep = pa.array(bound >= needed(nx, ny, percent))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(bound, pa.int64())], ["a", "b", "bound"]).filter(keep)

    side = classes.select("class", "counts", "n")
    rows = pairs.join(side.select(F.col("class").alias("a"), F.col("counts").alias("x"), F.col("n").alias("nx")), "a").join(
        side.select(F.col("class").alias("b"), F.col("counts").alias("y"), F.col("n").alias("ny")), "b")
    return rows.select("a", "b", "x", "y", "nx", "ny").mapInArrow(run, "a long, b long, bound long")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum()) >= needed(len(x), len(y), percent)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes whose exact overlap suffices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                    for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = sets.select("class", "grams")
    rows = pairs.join(side.select(F.col("class").alias("a"), F.col("grams").alias("x")), "a").join(
        side.select(F.col("class").alias("b"), F.col("grams").alias("y")), "b")
    return rows.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def verified_groups(pairs: DataFrame, groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among the candidate pairs (a, b, bound) of groups (node, root) of bounded size: every set
    moves to its group once; pairs of one component by then need no overlap."""

    def link(key, own: pa.Table, asked: pa.Table) -> pa.Table:
        held = dict(zip(own.column("class").to_pylist(), own.column("grams").to_pylist(), strict=True))
        parent = {c: c for c in held}

        def find(c):
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        out = []
        rows = sorted(zip(*(asked.column(c).to_pylist() for c in ("bound", "a", "b")), strict=True), reverse=True)
        for _, a, b in rows:
            x, y = find(a), find(b)
            if x != y and _similar(np.frombuffer(held[a], np.uint64), np.frombuffer(held[b], np.uint64), percent):
                parent[x] = y
                out.append((a, b))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    own = sets.join(groups.select(F.col("node").alias("class"), F.col("root").alias("own")), "class")
    asked = pairs.join(groups.select(F.col("node").alias("a"), F.col("root").alias("asked")), "a")
    return own.groupBy("own").cogroup(asked.groupBy("asked")).applyInArrow(link, "a long, b long")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose classes are in different components so far."""
    root = lambda c, name: F.coalesce(F.col(name), F.col(c))
    return (pairs.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left")
            .join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
            .filter(root("a", "ra") != root("b", "rb")).drop("ra", "rb"))


def _strongest(pairs: DataFrame, most: int) -> DataFrame:
    """For each class its ``most`` pairs of highest bound."""
    ends = pairs.select("a", "b", "bound", F.explode(F.array("a", "b")).alias("end"))
    rank = F.row_number().over(Window.partitionBy("end").orderBy(F.desc("bound"), "a", "b"))
    return ends.withColumn("rank", rank).filter(F.col("rank") <= most).select("a", "b").distinct()


def _residual(members: DataFrame, roots: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs within large buckets: classes outside a bucket's main component against all others."""
    rows = members.select("key", F.col("a").alias("class"), "k", "n").join(
        roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    sizes = rows.groupBy("key", "root").agg(F.count("*").alias("size"))
    by_key = sizes.groupBy("key").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.sum("size").alias("all"),
                                      F.count("*").alias("parts")).filter("parts > 1")
    # a bucket's members are spread over SALTS tasks while they learn its main component
    by_key = by_key.withColumn("salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})")))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(SALTS)).cast("int"))
    rows = rows.join(by_key, ["key", "salt"]).join(classes.select("class", "counts"), "class")
    rows = rows.withColumn("rest", F.col("root") != F.col("main")).withColumn(
        "cuts", F.ceil(F.col("all") / BLOCK).cast("int")).withColumn("cut", F.pmod(F.xxhash64("class"), F.col("cuts")).cast("int"))
    # block (i, j): the rest of cut i against all of cut j
    asked = rows.filter("rest").select("*", F.explode(F.expr("sequence(0, cuts - 1)")).alias("j")).withColumn("i", F.col("cut")).withColumn("side", F.lit(0))
    all_rows = rows.select("*", F.explode(F.expr("sequence(0, cuts - 1)")).alias("i")).withColumn("j", F.col("cut")).withColumn("side", F.lit(1))
    cols = ["key", "i", "j", "side", "class", "root", "k", "n", "counts"]

    def compare(table: pa.Table) -> pa.Table:
        v = {c: table.column(c).to_numpy() for c in ("side", "class", "root", "k", "n")}
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), "<u2").reshape(-1, FRAGMENTS)
        all_at = np.flatnonzero(v["side"] == 1)
        out = []
        for r in np.flatnonzero(v["side"] == 0):
            ok = all_at[v["root"][all_at] != v["root"][r]]
            ok = ok[_feasible(v["k"][r], v["n"][r], v["class"][r], v["k"][ok], v["n"][ok], v["class"][ok], percent)]
            if len(ok):
                x = counts[ok]
                bound = np.where((x == 65_535) | (counts[r] == 65_535), v["n"][r], np.minimum(x, counts[r])).sum(1, dtype=np.int64)
                good = bound >= needed(v["n"][r], v["n"][ok], percent)
                other = v["class"][ok[good]]
                out.append(np.stack([np.minimum(other, v["class"][r]), np.maximum(other, v["class"][r]), bound[good]], 1))
        out = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
        return pa.Table.from_arrays([pa.array(out[:, k]) for k in range(3)], ["a", "b", "bound"])

    return asked.select(cols).unionByName(all_rows.select(cols)).groupBy("key", "i", "j").applyInArrow(
        compare, "a long, b long, bound long").distinct()


def near_classes(rows: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """((doc_id, text_key, n, class) of every row, (node, root) of the classes that have a link)."""
    spark = rows.sparkSession
    keyed = rows.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    for seed in range(8):
        profiles = stored(keyed.mapInArrow(_profiles(words, seed), "doc_id long, text_key long, n long, class long, check long, counts binary"), "profiles")
        clash = profiles.groupBy("class").agg(F.min("check").alias("low"), F.max("check").alias("high")).filter("low <> high")
        if clash.isEmpty():
            break
    else:
        raise ValueError("64-bit class numbers clash for every seed")
    order = spark.sparkContext.broadcast(global_order(rows, words))
    entries = rows.select("text").mapInArrow(_entries(words, percent, seed, order), "key long, k int, n int, class long")
    met = stored(entries.repartition(shuffle_parts(spark), "key").sortWithinPartitions("key", "k", "n", "class")
                 .mapInArrow(_meet(percent), "key long, a long, b long, k long, n long"), "met")
    members = met.filter("key is not null")
    classes = profiles.filter("n > 0").select("class", "counts", "n").dropDuplicates(["class"])
    candidates = stored(_bounded(met.filter("key is null").select("a", "b").distinct(), classes, percent), "candidates")
    wanted = spark.sparkContext.broadcast(_filter(
        candidates.select(F.explode(F.array("a", "b")).alias("class")).unionByName(members.select(F.col("a").alias("class")))))
    sets = stored(rows.select("text").mapInArrow(_sets(words, seed, wanted), "class long, grams binary").dropDuplicates(["class"]), "sets")

    # groups of classes that candidates connect: small ones are verified in one place, of large ones pair by pair
    groups = stored(components(candidates.select("a", "b")), "groups")
    small = groups.join(groups.groupBy("root").count().filter(F.col("count") <= GROUP), "root", "left_semi")
    large = groups.join(groups.groupBy("root").count().filter(F.col("count") > GROUP), "root", "left_semi")
    big = candidates.join(large.select(F.col("node").alias("a")), "a", "left_semi")
    links = stored(verified_groups(candidates, small, sets, percent).unionByName(verified(_strongest(big, 1), sets, percent)), "verified")
    roots = stored(components(links), "roots")
    rest = _apart(big, roots)
    if not big.isEmpty():
        links = _links(roots).unionByName(verified(rest.select("a", "b"), sets, percent))
        roots = stored(components(links), "roots")
    if not members.isEmpty():
        candidates = stored(_residual(members, roots, classes, percent), "candidates")
        links = stored(_links(roots).unionByName(verified(_strongest(candidates, 2), sets, percent)), "verified")
        roots = stored(components(links), "roots")
        links = _links(roots).unionByName(verified(_apart(candidates, roots).select("a", "b"), sets, percent))
        roots = stored(components(links), "roots")
    return profiles.drop("check"), roots


def _links(roots: DataFrame) -> DataFrame:
    return roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, class, component_id (the smallest id reachable by
    links), text_key (xxhash64 of the text) and kept: true for one (id, text) of each component.

    Words are runs of other characters than ASCII white space, A-Z lower-cased; texts of fewer than
    ``words`` words are one n-gram. Two rows link when 100 * overlap >= percent * union of their
    sets. Null, empty and blank texts have an empty set, link with nothing and are kept. Null ids
    count as larger than all; a component of null ids only has a null component_id. Repeated rows
    link with each other and agree in ``kept``. An empty table gives no rows.
    """
    profiles, roots = near_classes(texts(docs, id_col, text_col), words, percent)
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "class", "text_key")
    firsts = profiles.filter("n > 0").groupBy("class").agg(F.min(row).alias("first"))
    own = firsts.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    lowest = own.groupBy("root").agg(F.min("first").alias("first"))
    by_class = own.select("class", "root").join(lowest, "root").select("class", "first")
    # a class of thousands of copies is a hot key of this join: the join is split where it is
    return profiles.join(by_class, "class", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), "class",
        F.when(F.col("n") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"), "text_key",
        ((F.col("n") == 0) | F.col("first").eqNullSafe(row)).alias("kept"))
