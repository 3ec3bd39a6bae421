"""The registered queries of this subpackage: thin calls of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docket.llm.common import scratch, tokenizer
from docket.llm.exact_dedup import exact_dedup
from docket.llm.fingerprints import edited_likeness
from docket.llm.language_id import identify
from docket.llm.license_scan import license_scan
from docket.llm.ngram_join import near_duplicates
from docket.llm.packing import pack
from docket.llm.passage_dedup import remove_repeats
from docket.llm.sentence_pieces import encode
from docket.llm.spelling import variants, vocabulary
from docket.llm.token_counts import token_counts
from docket.llm.token_file import read_tokens, write_tokens
from docket.llm.toxicity import toxicity
from docket.llm.turn_repair import damaged, repair
from docket.llm.turn_repair_sql import REPAIR_SQL, crc32_sql
from docket.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@_query("op1_fingerprints")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))


@_query("op2_sentence_pieces")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer("piece_bpe_32k.model")
    return encode(table(spark, sf_dir, "documents"), path, decoded=True)


@_query("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@_query("op4_ngram_jaccard", r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(
    range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM split),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, len(s) AS n_shingles, (SELECT min(b) FROM reach WHERE a = doc_id) AS component_id FROM sets""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=85).select("doc_id", "n_shingles", "component_id")


@_query("op5_exact_dedup", r"""
WITH keyed AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM keyed WINDOW same AS (PARTITION BY norm)""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


@_query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


@_query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


@_query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query("op9_license_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


@_query("op10_token_file")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer("word_bpe_49k.json"))
    return read_tokens(spark, path)


@_query("op11_turn_repair", REPAIR_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


@_query("op12_passage_dedup", r"""
WITH split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
spans AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS span
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM split WHERE len(w) >= 50)),
firsts AS (SELECT span, min(doc_id) AS low FROM spans GROUP BY span HAVING min(doc_id) <> max(doc_id)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM spans JOIN firsts USING (span) WHERE doc_id > low),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM split) s
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = s.doc_id AND g.i = s.i) GROUP BY doc_id)
SELECT s.doc_id, len(w) AS n_words, len(w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON k.doc_id = s.doc_id""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


_RUN_BYTES = ("flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''), "
              "lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [195, ord(x)::BIGINT - 64] END))")


@_query("op13_spelling_variants", rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
  WHERE len(run) >= 5 GROUP BY doc_id, run),
hashed AS (SELECT run, n, {crc32_sql(_RUN_BYTES)} AS h FROM runs),
words AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT n, CASE WHEN h % 97 = 0 THEN left(run, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word FROM hashed)
  WHERE len(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
places AS (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM words),
holes AS (SELECT word, n, left(word, i - 1) || '*' || substr(word, i + 1) AS hole FROM places),
shorter AS (
  SELECT DISTINCT p.word, p.n, w.word AS near, w.n AS near_n
  FROM places p JOIN words w ON w.word = left(p.word, i - 1) || substr(p.word, i + 1)),
nears AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.hole = b.hole AND a.word <> b.word
  UNION ALL SELECT word, near, near_n FROM shorter
  UNION ALL SELECT near, word, n FROM shorter),
best AS (
  SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near,
         row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM nears),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form,
         CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word AND place = 1),
walk AS (
  SELECT word, word AS last, 0 AS step FROM formed
  UNION ALL SELECT k.word, f.form, step + 1 FROM walk k JOIN formed f ON f.word = k.last WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n
FROM formed f JOIN (SELECT word, arg_max(last, step) AS root FROM walk GROUP BY word) r ON r.word = f.word""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(table(spark, sf_dir, "documents")))
