"""License scan by ordered signature rules.

A text is lower-cased (A-Z) and cut to words. An Aho-Corasick automaton over the rules' keywords
passes a text in one walk; only rules whose keyword occurs are run, over the words joined by single
spaces. A detection inside the interval of one with higher priority (or, at equal priority, of a
longer one or an earlier rule) is suppressed. Base phrases are counted at every place where their
words stand in a row, and their labels always stay.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from docket.llm.common import texts
from docket.llm.license_rules import BASE, Rule, rules

#: UTF-8 bytes that are no part of a word become blanks; those beyond ASCII all belong to words.
_WORD_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
#: How much a base place alone counts as confidence.
BASE_CONFIDENCE = 0.9

Found = tuple[int, int, int, int, float, str, str]  # start, end, priority, rule number, confidence, label, rule


def words(text: str) -> list[bytes]:
    """Words of a text in lower case (A-Z only)."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_WORD_BYTES).split()


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    all_rules = rules()
    automaton = ahocorasick.Automaton()
    by_keyword: dict[str, list[int]] = {}
    for i, r in enumerate(all_rules):
        by_keyword.setdefault(r.keyword, []).append(i)
    for k, v in by_keyword.items():
        automaton.add_word(k, v)
    automaton.make_automaton()
    return automaton, all_rules


def detections(line: str) -> list[Found]:
    """All matches of all rules in words joined by single spaces; places are word numbers."""
    automaton, all_rules = _automaton()
    wanted = {i for _, group in automaton.iter(line) for i in group}
    out: list[Found] = []
    for i in sorted(wanted):
        r: Rule = all_rules[i]
        at = before = 0
        for m in r.pattern.finditer(line):
            before += line.count(" ", at, m.start())
            at = m.start()
            out.append((before, before + m[0].count(" ") + 1, r.priority, i, r.confidence, r.label, r.name))
    return out


def resolve(found: list[Found]) -> list[Found]:
    """Without detections that lie inside one that outranks them."""
    kept: list[Found] = []
    starts: list[int] = []
    furthest: list[int] = []
    ranked = sorted(found, key=lambda d: (-d[2], d[0] - d[1], d[3], d[0]))
    new: list[Found] = []
    for k, d in enumerate(ranked):
        if new and (d[2], d[1] - d[0], d[3]) != (ranked[k - 1][2], ranked[k - 1][1] - ranked[k - 1][0], ranked[k - 1][3]):
            kept += new
            new = []
            spans = sorted((x[0], x[1]) for x in kept)
            starts = [a for a, _ in spans]
            furthest = list(accumulate((b for _, b in spans), max))
        i = bisect_right(starts, d[0])
        if not i or furthest[i - 1] < d[1]:
            new.append(d)
    return sorted(kept + new)


@lru_cache(maxsize=1)
def _base():
    return [(label, phrase, re.compile(rf"(?<![^ ]){phrase}(?![^ ])"), phrase.count(" ") + 1) for label, phrase in BASE]


def base_places(line: str) -> list[tuple[int, str]]:
    """(first word, label) of every place of a base phrase."""
    out = []
    for label, phrase, pattern, _ in _base():
        if phrase in line:
            at = before = 0
            for m in pattern.finditer(line):
                before += line.count(" ", at, m.start())
                at = m.start()
                out.append((before, label))
    return sorted(out)


_FINDING = pa.struct([("rule", pa.string()), ("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("confidence", pa.float64())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            tokens = words(text)
            line = b" ".join(tokens).decode("utf-8", "replace")
            places = base_places(line)
            kept = resolve(detections(line))
            base = {label for _, label in places}
            score = max([0.0, *(d[4] for d in kept), *([BASE_CONFIDENCE] if places else [])])
            out.append((doc, len(tokens), len(places), places[0][0] if places else None, places[-1][0] if places else None,
                        ",".join(sorted(base)), ",".join(sorted(base | {d[5] for d in kept})), score,
                        [{"rule": d[6], "label": d[5], "first_word": d[0], "last_word": d[1] - 1, "confidence": d[4]} for d in kept]))
        cols = list(zip(*out, strict=True)) or [()] * 9
        types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.list_(_FINDING)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [
            "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "findings"])


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score (the highest confidence of a kept detection) and findings (rule, label, first and last
    word, confidence).

    Null text: no words, no labels (empty strings), null places, score 0. Null and repeated ids and
    repeated rows give rows of their own. An empty table gives no rows.
    """
    return texts(docs, id_col, text_col).mapInArrow(
        _scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
               "score double, findings array<struct<rule:string,label:string,first_word:long,last_word:long,confidence:double>>")
