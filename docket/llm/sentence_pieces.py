"""SentencePiece encoding and decoding as a relational lattice.

A text (a blank in front, blanks as U+2581) is cut to words between all characters that stand
side by side in no piece: no piece crosses such a place. Distinct words are encoded once: their
substrings up to the longest piece's length are exploded and joined to the piece table, matches are
the edges of the word's lattice, grouped by word, and folded with Spark's higher-order
``aggregate``. For a unigram model the fold is Viterbi: the best-scoring path. For a BPE model, as
the public file is, the best-scoring path is not the model's segmentation, so the fold takes merges
instead: at each step the adjacent pair whose joint piece has the highest score (the leftmost of
equals) becomes one. Edges come in that order, so a pass over them makes most words' merges. A word
none of whose characters is a piece becomes its bytes.

Documents then look up their words' ids. The word table goes to the workers as flat arrays while
its checked size allows, otherwise it is joined.
"""

from __future__ import annotations

import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha512

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket.llm.common import stored, texts

BLANK = "▁"
#: Characters of a word that the lattice takes; a bit of a long per place between them.
LONGEST_WORD = 60
#: Distinct words that a task combines; bytes of a table that workers may hold.
COMBINED, SHARED_BYTES = 200_000, 96 << 20
#: Rows, and bytes of their texts if there are more than one, that a task cuts, encodes and decodes at a time.
HELD_ROWS, HELD_BYTES = 256, 1 << 19
#: A bit above a word's places: the pass over its edges stopped, as one that it had passed fits now.
AGAIN = 1 << 62
UNIGRAM, BPE = 1, 2


class Pieces:
    """The pieces of a model file, and where texts may be cut."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        with open(path, "rb") as f:
            proto = ModelProto.FromString(f.read())
        self.kind = proto.trainer_spec.model_type
        self.library = SentencePieceProcessor(model_file=path)
        normal = {1, 4}  # normal and user-defined pieces have text
        self.rows = [(p.piece, i, float(p.score)) for i, p in enumerate(proto.pieces) if p.type in normal]
        self.longest = max(len(p) for p, _, _ in self.rows)
        byte_ids = [i for i, p in enumerate(proto.pieces) if p.type == 6]
        self.first_byte = byte_ids[0]
        if byte_ids != list(range(self.first_byte, self.first_byte + 256)):
            raise ValueError("the model has no run of 256 byte pieces")
        self.bytes = [p.piece.encode() if p.type != 6 else bytes([i - self.first_byte]) for i, p in enumerate(proto.pieces)]
        for i, p in enumerate(proto.pieces):
            if p.type == 3:  # control pieces have no text
                self.bytes[i] = b""
        self.near = {p[i: i + 2] for p, _, _ in self.rows for i in range(len(p) - 1)}
        if any(b == BLANK != a for a, b in self.near):
            raise ValueError("a piece has a blank behind another character")
        chars = sorted({c for pair in self.near for c in pair})
        self.char = np.zeros(sys.maxunicode + 1, np.uint16)  # 0: in no pair
        self.char[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.apart = np.ones((len(chars) + 1, len(chars) + 1), bool)
        self.apart[tuple(self.char[[ord(x[i]) for x in self.near]] for i in (0, 1))] = False
        self.id = {p: i for p, i, _ in self.rows}

    def cut(self, texts: list[str]) -> Cut:
        """The texts, a blank in front of each that is not empty, cut to words between all characters
        that stand side by side in no piece, and between texts."""
        spaced = [BLANK + t.replace(" ", BLANK) if t else "" for t in texts]
        codes = _codes("".join(spaced))
        kind = self.char[codes]
        first = np.ones(len(codes), bool)
        first[1:] = self.apart[kind[:-1], kind[1:]]
        at = np.cumsum([0, *map(len, spaced)])
        first[at[:-1][np.diff(at) > 0]] = True
        return Cut(codes, np.flatnonzero(first), at)

    def words(self, text: str) -> list[str]:
        """The text as words; joined they are the text with its blanks as U+2581."""
        return self.cut([text]).words()

    def places(self) -> list[tuple[str, int, float, bool]]:
        """(piece, place, score, late) of pieces of two or more characters: their place by falling score,
        equal for equal scores, and whether a merge of lesser or equal score can make a part that the piece needs."""
        score = {p: s for p, _, s in self.rows}
        place = {s: i for i, s in enumerate(sorted(set(score.values()), reverse=True))}

        def late(p: str) -> bool:
            return any(score.get(x, np.inf) <= score[p] for i in range(2, len(p)) for x in (p[:i], p[-i:]))

        return [(p, place[s], s, late(p)) for p, s in score.items() if len(p) > 1]

    def between(self, word: str, mask: int) -> list[int]:
        """The ids of a word's segments between the places of ``mask``; the bytes of a character that is no piece."""
        at = [i for i in range(len(word) + 1) if mask >> i & 1]
        out = []
        for a, b in zip(at, at[1:], strict=False):
            i = self.id.get(word[a:b])
            if i is None:
                out += [self.first_byte + x for x in word[a:b].encode("utf-8", "surrogatepass")]
            else:
                out.append(i)
        return out

    def long_word(self, word: str) -> list[int]:
        """The library's ids of a word beyond the lattice; a line feed keeps its blank from it."""
        return self.library.encode("\n" + word)[2:]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, blanks restored, the first one dropped."""
        s = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace").replace(BLANK, " ")
        return s[1:] if s.startswith(" ") else s


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


#: Odd factors of a character's place in its word, for two hashes.
FACTORS = np.frombuffer(b"".join(sha512(b"%d" % i).digest()[:16] for i in range(LONGEST_WORD + 1)), "<u8").reshape(-1, 2).T | np.uint64(1)


class Cut:
    """Texts cut to words: code points, each word's first place and length, each text's first place."""

    def __init__(self, codes: np.ndarray, first: np.ndarray, at: np.ndarray):
        self.codes, self.first, self.at = codes, first, at
        self.size = np.diff(first, append=len(codes))
        self.short = self.size <= LONGEST_WORD
        self.text = np.searchsorted(at, first, "right") - 1  # the last of those that begin there is not empty

    def hashes(self, which: int = 0) -> np.ndarray:
        """64 bits of each word: the sum of its code points, from 1, times their places' factors."""
        out = np.zeros(len(self.first), np.uint64)
        # in blocks, for a text of any length
        blocks = np.unique(np.searchsorted(self.first, np.arange(0, len(self.codes) + HELD_BYTES, HELD_BYTES)))
        for a, b in zip(blocks, blocks[1:], strict=False):
            first, size = self.first[a:b] - self.first[a], self.size[a:b]
            codes = self.codes[self.first[a]: self.first[a] + size.sum()]
            place = np.minimum(np.arange(len(codes)) - np.repeat(first, size), LONGEST_WORD)
            out[a:b] = np.add.reduceat((codes + np.uint64(1)) * FACTORS[which][place], first)
        return out.view(np.int64)

    def words(self, some: np.ndarray | slice = slice(None)) -> list[str]:
        whole = self.codes.tobytes().decode("utf-32-le", "surrogatepass")
        return [whole[a:b] for a, b in zip(self.first[some].tolist(), (self.first + self.size)[some].tolist(), strict=True)]


def _hashes(words: list[str]) -> np.ndarray:
    """The hashes of words that are not empty."""
    at = np.cumsum([0, *map(len, words)])
    return Cut(_codes("".join(words)), at[:-1], at).hashes()


def _few(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most HELD_ROWS rows and, where there are more than one, HELD_BYTES."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            n = min(HELD_ROWS, max(1, int(np.searchsorted(ends, before + HELD_BYTES, "right")) - at))
            yield batch.slice(at, n)
            at += n


def word_counts(rows: DataFrame, path: str) -> DataFrame:
    """(word, n) of all distinct words up to the lattice's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words = pieces(path), Counter()

        def out():
            batch = pa.RecordBatch.from_pydict({"word": pa.array(words.keys(), pa.string()), "n": pa.array(words.values(), pa.int64())})
            words.clear()
            return batch

        for batch in _few(batches):
            cut = model.cut(batch.column("text").to_pylist())
            short = np.flatnonzero(cut.short)
            one, other = (cut.hashes(i)[short] for i in (0, 1))
            _, some, same, n = np.unique(one, return_index=True, return_inverse=True, return_counts=True)
            if (other[some][same] == other).all():
                for w, k in zip(cut.words(short[some]), n.tolist(), strict=True):
                    words[w] += k
            else:  # different words of equal hashes
                words.update(cut.words(short))
            if len(words) >= COMBINED:
                yield out()
        yield out()

    return rows.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lattice(words: DataFrame, table: DataFrame, longest: int, edge: Column) -> DataFrame:
    """(word, n, edges): for each piece of two characters or more in the word ``edge``, sorted.

    ``edge`` is made of the piece's columns in ``table``, its first place in the word and its ``len``.
    """
    spans = words.select("word", "n", F.length("word").alias("size")).select(
        "word", "n", "size", F.explode(F.expr("sequence(0, size)")).alias("first")).select(
        "word", "n", "first", F.explode(F.expr(
            f"if(first = size, array(0), if(first = size - 1, array(), sequence(2, least({longest}, size - first))))")).alias("len"))
    cut = spans.withColumn("piece", F.expr("substring(word, first + 1, len)"))
    # the piece table is fixed by the model file; its empty piece keeps words without an edge
    found = cut.join(F.broadcast(table), "piece").select("word", "n", F.when(F.col("len") > 0, edge).alias("edge"))
    return found.groupBy("word", "n").agg(F.sort_array(F.collect_list("edge")).alias("edges"))


def merged(words: DataFrame, table: DataFrame, longest: int) -> DataFrame:
    """(word, n, mask): places left after all merges of a BPE model.

    An edge is one number: the piece's place by score, first, len, late. It fits when the places of
    its ends are left and one between them. A merge makes only edges fit that begin or end with it;
    where one of those comes earlier in the order (it is late), the pass stops and begins again.
    """
    edges = lattice(words, table, longest, F.expr("shiftleft(cast(place as long), 20) + shiftleft(first, 12) + shiftleft(len, 1) + int(late)"))
    masks = edges.withColumn("pairs", F.expr("""transform(edges, e -> named_struct('edge', e,
        'ends', shiftleft(shiftleft(1L, int(shiftright(e, 1) & 2047)) + 1L, int(shiftright(e, 12) & 255)),
        'inside', shiftleft(shiftleft(1L, int(shiftright(e, 1) & 2047)) - 2L, int(shiftright(e, 12) & 255))))"""))

    def fits(e: Column, mask: Column) -> Column:
        return (e.ends.bitwiseAND(mask) == e.ends) & (F.bit_count(e.inside.bitwiseAND(mask)) == 1)

    def step(mask: Column, e: Column) -> Column:
        left = mask.bitwiseAND(F.bitwise_not(e.inside))
        passed = F.exists("late", lambda x: (x.edge < e.edge) & fits(x, left))
        return F.when((mask < AGAIN) & fits(e, mask), F.when(passed, left.bitwiseOR(F.lit(AGAIN))).otherwise(left)).otherwise(mask)

    def again(mask: Column, _) -> Column:
        return F.when(mask < AGAIN, mask).otherwise(F.aggregate("pairs", mask - F.lit(AGAIN), step))

    late = masks.withColumn("late", F.filter("pairs", lambda e: e.edge.bitwiseAND(F.lit(1)) == 1))
    start = F.expr("shiftleft(1L, length(word) + 1) - 1L").bitwiseOR(F.lit(AGAIN))
    # a pass that stops has made a merge
    turns = F.expr("sequence(1, greatest(1, length(word)))")
    return late.select("word", "n", F.aggregate(turns, start, again).alias("mask"))


def viterbi(words: DataFrame, table: DataFrame, model: Pieces) -> DataFrame:
    """(word, n, mask): places of the path with the highest sum of scores."""
    edges = lattice(words, table, model.longest, F.struct((F.col("first") + F.col("len")).alias("end"), "first", (-F.col("score")).alias("cost")))
    unknown = min((s for _, _, s in model.rows), default=0.0) - 10.0
    costs = {ord(p): -s for p, _, s in model.rows if len(p) == 1}
    low = F.array(*[F.lit(costs.get(c, -unknown)) for c in range(1024)])
    high = [x for c, v in sorted(costs.items()) if c >= 1024 for x in (F.lit(c), F.lit(v))]

    def char_cost(i: Column) -> Column:
        code = F.ascii(F.substring(F.col("word"), i + 1, F.lit(1)))
        rest = F.coalesce(F.try_element_at(F.create_map(*high), code), F.lit(-unknown)) if high else F.lit(-unknown)
        return F.when(code < 1024, F.get(low, code)).otherwise(rest)

    chars = F.transform(F.expr("sequence(0, length(word) - 1)"), lambda i: F.struct(
        (i + 1).alias("end"), i.alias("first"), char_cost(i).alias("cost")))
    by_end = F.sort_array(F.concat(chars, "edges"))
    none = F.struct(F.lit(float("inf")).alias("cost"), F.lit(0).cast("long").alias("mask"))
    first = F.struct(F.lit(0.0).alias("cost"), F.lit(1).cast("long").alias("mask"))
    start = F.transform(F.expr("sequence(0, length(word))"), lambda i: F.when(i == 0, first).otherwise(none))

    def relax(best: Column, e: Column) -> Column:
        at, to = F.get(best, e.first), F.get(best, e.end)
        cost = at.cost + e.cost
        mask = at.mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), e.end))
        return F.when(cost < to.cost, F.transform(best, lambda x, i: F.when(i == e.end, F.struct(cost.alias("cost"), mask.alias("mask"))).otherwise(x))).otherwise(best)

    return edges.withColumn("mask", F.get(F.aggregate(by_end, start, relax), F.length("word")).mask)


def encode_words(words: DataFrame, path: str, kind: int | None = None) -> DataFrame:
    """(word, n, hash, ids) of distinct words (word, n), by the fold of the model's kind."""
    model = pieces(path)
    table = words.sparkSession.createDataFrame([*model.places(), ("", 0, 0.0, False)], "piece string, place int, score double, late boolean")
    folded = viterbi(words, table, model) if (kind or model.kind) == UNIGRAM else merged(words, table, model.longest)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            words = batch.column("word").to_pylist()
            ids = [model.between(w, m) for w, m in zip(words, batch.column("mask").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(_hashes(words)),
                                              pa.array(ids, pa.list_(pa.int32()))], ["word", "n", "hash", "ids"])

    return folded.select("word", "n", "mask").mapInArrow(named, "word string, n long, hash long, ids array<int>")


class Words:
    """Ids of words as flat arrays sorted by hash: 16 bytes a word and 2 an id."""

    def __init__(self, table: pa.Table):
        h = table.column("hash").to_numpy()
        order = np.argsort(h)
        ids = table.column("ids").combine_chunks()
        offsets = ids.offsets.to_numpy().astype(np.int64) if len(h) else np.zeros(1, np.int64)
        self.hash, self.first, self.last = h[order], offsets[:-1][order].astype(np.uint32), offsets[1:][order].astype(np.uint32)
        self.ids = (ids.values.to_numpy() if len(h) else np.zeros(0, np.int32)).astype(np.uint16)

    def find(self, cut: Cut) -> np.ndarray:
        """The place of each word of ``cut``, -1 where it is not held."""
        if not len(self.hash):
            return np.full(len(cut.first), -1)
        h, same = np.unique(cut.hashes(), return_inverse=True)
        i = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(cut.short, np.where(self.hash[i] == h, i, -1)[same], -1)


def _runs(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` from ``first`` on, one behind the other."""
    behind = np.cumsum(size)
    return flat[np.repeat(first - behind + size, size) + np.arange(behind[-1] if len(behind) else 0)]


class Encoder:
    """Ids of texts from held words and words given for one text."""

    def __init__(self, model: Pieces, held: Words):
        self.model, self.held = model, held

    def lacking(self, texts: list[str]) -> list[list[str]]:
        """For each text its distinct words that the table does not hold."""
        cut = self.model.cut(texts)
        some = np.flatnonzero((self.held.find(cut) < 0) & cut.short)
        out: list[dict[str, None]] = [{} for _ in texts]
        for t, w in zip(cut.text[some].tolist(), cut.words(some), strict=True):
            out[t][w] = None
        return [list(x) for x in out]

    def ids(self, texts: list[str], own: list[dict[str, np.ndarray]] | None = None) -> list[np.ndarray]:
        cut = self.model.cut(texts)
        at = self.held.find(cut)
        some = np.flatnonzero(at < 0)
        first, size = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        first[at >= 0] = self.held.first[at[at >= 0]]
        size[at >= 0] = self.held.last[at[at >= 0]] - first[at >= 0]
        lacked = []
        for t, w, short in zip(cut.text[some].tolist(), cut.words(some), cut.short[some].tolist(), strict=True) if len(some) else ():
            lacked.append(own[t][w] if short else np.array(self.model.long_word(w), np.uint16))
        size[some] = [len(x) for x in lacked]
        behind = np.cumsum(size)
        flat = np.zeros(behind[-1] if len(size) else 0, np.uint16)
        if len(some):
            held = size.copy()
            held[some] = 0
            known = np.ones(len(flat), bool)
            places = _runs(np.arange(len(flat)), (behind - size)[some], size[some])
            known[places] = False
            flat[known] = _runs(self.held.ids, first, held)
            flat[places] = np.concatenate(lacked)
        else:
            flat = _runs(self.held.ids, first, size)
        of_text = np.bincount(cut.text, size, len(texts)).astype(np.int64)
        return np.split(flat, np.cumsum(of_text)[:-1]) if texts else []


IDS = "doc_id long, text string, ids array<int>"
DIGESTS = "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean"


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shared_bytes: int = SHARED_BYTES,
           decoded: bool = False) -> DataFrame:
    """One row per input row: doc_id, text, ids (array of int); with ``decoded`` the digests of
    ``decode`` instead, made in the same pass.

    Null and empty texts have no ids. Null and repeated ids and repeated rows give rows of their
    own. An empty table gives no rows.
    """
    rows, model = texts(docs, id_col, text_col), pieces(path)
    if len(model.bytes) > 1 << 16:
        raise ValueError("ids of more than 16 bits")
    words = stored(encode_words(word_counts(rows, path), path), "words")
    held, whole = shared_words(words, shared_bytes)
    table = docs.sparkSession.sparkContext.broadcast(held)  # its size has been checked
    if whole:
        return rows.mapInArrow(_with_ids(path, table, decoded, False), DIGESTS if decoded else IDS)
    return _joined(rows, path, words, table, decoded)


def shared_words(words: DataFrame, most: int) -> tuple[Words, bool]:
    """The words that every worker holds, and whether these are all: the most frequent ones, from the
    least power of two of their counts on that keeps the arrays within ``most`` bytes. Words whose
    hashes clash are left to the join."""
    power = F.floor(F.log2("n")).cast("int")
    left, least, whole = most, 64, True
    for r in words.groupBy(power.alias("p")).agg(F.sum(16 + 2 * F.size("ids")).alias("size")).orderBy(F.desc("p")).collect():  # at most 64 rows
        left -= r["size"]
        if left < 0:
            whole = False
            break
        least = r["p"]
    clash = words.groupBy("hash").agg(F.count("*").alias("k")).filter("k > 1").select("hash")
    clashes = not clash.isEmpty()
    chosen = words.filter(power >= least)
    if clashes:
        chosen = chosen.join(clash, "hash", "left_anti")
    return Words(chosen.select("hash", "ids").toArrow()), whole and not clashes


def _with_ids(path: str, table, decoded: bool, own: bool):
    """Texts to ids, or to the digests of ``decode``; with ``own`` a row brings the words its workers do not hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        encoder = Encoder(model, table.value)
        for batch in _few(batches):
            texts = batch.column("text").to_pylist()
            more = [{x["word"]: np.array(x["ids"], np.uint16) for x in r or ()} for r in batch.column("own").to_pylist()] if own else None
            out = encoder.ids(texts, more)
            if decoded:
                yield _digests(model, batch.column("doc_id"), texts, out)
                continue
            sizes = np.cumsum([0, *map(len, out)]).astype(np.int32)
            flat = np.concatenate(out).astype(np.int32) if out else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"),
                                              pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))], ["doc_id", "text", "ids"])

    return run


def _joined(rows: DataFrame, path: str, words: DataFrame, table, decoded: bool) -> DataFrame:
    """For a word table of any size: the distinct words of a document that workers do not hold meet
    their ids in a shuffled join, and the document meets them once."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pieces(path), table.value)
        for batch in _few(batches):
            lacking = encoder.lacking(batch.column("text").to_pylist())
            at = np.repeat(np.arange(batch.num_rows), [len(x) for x in lacking])
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(at)), pa.array([w for x in lacking for w in x], pa.string())], ["row", "word"])

    # the row number follows from the scan's order, so a task run again gives the same
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    found = numbered.select("row", "text").mapInArrow(spread, "row long, word string").join(words.select("word", "ids"), "word")
    own = found.groupBy("row").agg(F.collect_list(F.struct("word", "ids")).alias("own"))  # at most a text's distinct words
    return numbered.join(own, "row", "left").select("doc_id", "text", "own").mapInArrow(
        _with_ids(path, table, decoded, True), DIGESTS if decoded else IDS)


def _digests(model: Pieces, doc_ids: pa.Array, texts: list[str], ids: list[np.ndarray]) -> pa.RecordBatch:
    from hashlib import sha256

    back = [model.decode(own.tolist()) for own in ids]
    return pa.RecordBatch.from_arrays(
        [doc_ids, pa.array([len(own) for own in ids], pa.int64()), pa.array([zlib.crc32(own.astype("<u4").tobytes()) for own in ids], pa.int64()),
         pa.array([sha256(b.encode()).hexdigest() for b in back], pa.string()),
         pa.array([b == t for b, t in zip(back, texts, strict=True)], pa.bool_())],
        [c.split()[0] for c in DIGESTS.split(", ")])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, decoded_sha256, round_trip) of (doc_id, text, ids) rows: the digest
    of the ids as little-endian unsigned 32-bit integers, of the decoded text, and whether that is the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in _few(batches):
            offsets, flat = batch.column("ids").offsets.to_numpy(), batch.column("ids").values.to_numpy()
            own = [flat[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
            yield _digests(model, batch.column("doc_id"), batch.column("text").to_pylist(), own)

    return encoded.select("doc_id", "text", "ids").mapInArrow(run, DIGESTS)
