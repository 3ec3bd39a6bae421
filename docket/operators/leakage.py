"""Pre-decision text filter (re-aimed).

The original sends each description to a remote language model with
instructions to keep only pre-decision content.  Here the same intent is a
deterministic, JVM-side sentence filter: split into sentences, drop those
that mention the outcome, rejoin, and apply the same 30 000-character budget
with the truncation marker.

Which sentences mention the outcome is learnt.  The seed terms below and vote
counts give weak labels; words that are far more frequent in sentences with such
a label than in others get the logarithm of that ratio as weight, and a sentence
whose words' weights outweigh the rarity of outcome sentences is dropped as well,
without a seed term in it.  Counts are keyed aggregates over all sentences.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket.functions import strings as S
from docket.sources.files import stored

# Outcome vocabulary (ours): holdings, dispositions, opinions, vote counts.
OUTCOME_TERMS = [
    "held", "holds", "holding", "ruled", "rules that", "affirmed", "affirms", "reversed", "reverses",
    "remanded", "vacated", "dissent", "dissented", "dissenting", "concurred", "concurring",
    "majority opinion", "opinion of the court", "judgment", "decided",
]
VOTE_COUNT = r"[0-9]+ ?[-–] ?[0-9]+ (?:vote|decision|majority)"
NOT_WORD = r"[^\p{L}\p{N}_]"
SENTENCE = r"[^.!?]+(?:[.!?]+|$)"


#: Sentences that must hold a word before it is weighed; least weight of a word that counts.
LEAST_SENTENCES, LEAST_WEIGHT = 10, 2.0
WORD = r"[\p{L}\p{N}_]+"


def outcome_pattern(terms: Sequence[str] = OUTCOME_TERMS) -> str:
    alt = "|".join(t.replace(" ", "[ ]") for t in terms)
    return f"(?i)(?:^|{NOT_WORD})(?:{alt}|{VOTE_COUNT})(?:{NOT_WORD}|$)"


def leakage_sentence_filter(text: Column, terms: Sequence[str] = OUTCOME_TERMS) -> Column:
    """Keep only sentences without outcome vocabulary, then strip."""
    pat = outcome_pattern(terms)
    sentences = F.regexp_extract_all(text, F.lit(SENTENCE), 0)
    kept = F.filter(sentences, lambda s: ~s.rlike(pat))
    return S.strip(F.array_join(kept, ""))


def filter_for_budget(text: Column, prompt_len: int = 1000) -> Column:
    """Budget cut first (as the original does before its call), then filter."""
    return leakage_sentence_filter(S.truncate_to_budget(text, prompt_len))


def _sentences(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SENTENCE), 0)


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), 0))


def outcome_words(texts: DataFrame, text_col: str, terms: Sequence[str] = OUTCOME_TERMS, least: int = LEAST_SENTENCES,
                  least_weight: float = LEAST_WEIGHT) -> tuple[DataFrame, float]:
    """((word, weight), prior): words that tell outcome sentences from others, learnt from the weak labels of all
    sentences, and the log odds of an outcome sentence.  One pass counts words and sentences; the counts of the
    words that may be weighed are stored."""
    pattern = outcome_pattern(terms)
    s = texts.select(F.explode(_sentences(F.col(text_col))).alias("s")).select(_words(F.col("s")).alias("words"), F.col("s").rlike(pattern).alias("weak"))
    # the null word stands for the sentence itself
    itself = F.array(F.lit(None).cast("string"))
    rows = s.select("weak", F.explode(F.concat(itself, "words")).alias("word")).groupBy("word").agg(
        F.count_if("weak").alias("p"), F.count_if(~F.col("weak")).alias("n"))
    counts = stored(rows.filter(F.col("word").isNull() | (F.col("p") + F.col("n") >= least)), "outcome-words")
    total = counts.filter(F.col("word").isNull()).head() or {"p": 0, "n": 0}
    counts = counts.filter(F.col("word").isNotNull())
    weight = F.round(F.log((F.col("p") + 0.5) / (total["p"] + 1.0)) - F.log((F.col("n") + 0.5) / (total["n"] + 1.0)), 6)
    return (counts.select("word", weight.alias("weight")).filter(F.col("weight") >= least_weight),
            round(math.log((total["p"] + 1) / (total["n"] + 1)), 6))


def _scored(texts: DataFrame, id_col: str, text_col: str, weights: DataFrame) -> DataFrame:
    """``texts`` with ``__found``: the weighed words of each text, as a map."""
    words = texts.select(F.col(id_col).alias("__id"), F.explode(_words(F.col(text_col))).alias("word"))
    found = words.join(weights, "word").groupBy("__id").agg(F.map_from_entries(F.collect_set(F.struct("word", "weight"))).alias("__found"))
    return texts.join(found, F.col(id_col).eqNullSafe(F.col("__id")), "left").drop("__id")


def _learnt(sentence: Column, prior: float) -> Column:
    """Whether the weights of a sentence's words make an outcome likelier than not."""
    score = F.aggregate(_words(sentence), F.lit(0.0), lambda a, w: a + F.coalesce(F.try_element_at("__found", w), F.lit(0.0)))
    # a text without weighed words needs no look at its sentences' words
    return F.when(F.col("__found").isNull(), F.round(F.lit(prior), 4) > 0).otherwise(F.round(score + F.lit(prior), 4) > 0)


def learnt_filter(texts: DataFrame, id_col: str, text_col: str, weights: DataFrame, prior: float, out_col: str = "filtered",
                  terms: Sequence[str] = OUTCOME_TERMS) -> DataFrame:
    """(id, ``out_col``): the texts without sentences that hold a seed term or that the learnt words give away.
    Texts of one id share their words.  Null texts stay null."""
    pattern = outcome_pattern(terms)
    rows = _scored(texts.select(id_col, text_col), id_col, text_col, weights)
    kept = F.filter(_sentences(F.col(text_col)), lambda s: ~(s.rlike(pattern) | _learnt(s, prior)))
    return rows.select(id_col, S.strip(F.array_join(kept, "")).alias(out_col))


def held_out_measure(texts: DataFrame, id_col: str, text_col: str, terms: Sequence[str] = OUTCOME_TERMS, parts: int = 5) -> DataFrame:
    """One row: sentences of every ``parts``-th text (by id hash), and precision and recall there, against the weak
    labels, of the words learnt from the other texts alone (seed terms are not looked at)."""
    held = F.pmod(F.xxhash64(F.col(id_col)), F.lit(parts)) == 0
    weights, prior = outcome_words(texts.filter(~held), text_col, terms)
    rows = _scored(texts.filter(held).select(id_col, text_col), id_col, text_col, weights)
    s = rows.select("__found", F.explode(_sentences(F.col(text_col))).alias("s")).select(
        F.col("s").rlike(outcome_pattern(terms)).alias("weak"), _learnt(F.col("s"), prior).alias("learnt"))
    both = F.count_if(F.col("weak") & F.col("learnt"))
    return s.agg(F.count(F.lit(1)).alias("n_sentences"), F.round(both / F.count_if("learnt"), 6).alias("precision"),
                 F.round(both / F.count_if("weak"), 6).alias("recall"))
