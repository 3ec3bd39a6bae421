"""Literal edge rows (FIXTURES §4) for the column functions."""

import math

from pyspark.sql import functions as F

from docket.functions import arrays as A
from docket.functions import strings as S
from docket.operators import decode
from docket.operators.tally import vote_counts


def one(spark, expr, value, typ="string"):
    df = spark.createDataFrame([(value,)], f"x {typ}")
    return df.select(expr(F.col("x")).alias("y")).collect()[0]["y"]


def test_citation_to_url(spark):
    assert one(spark, S.citation_to_url, "329 U.S. 1") == S.CITATION_URL_PREFIX + "329/1/"
    assert one(spark, S.citation_to_url, "329 U.S 1") == S.CITATION_URL_PREFIX + "329/1/"
    assert one(spark, S.citation_to_url, "5 F.3d 2") is None
    assert one(spark, S.citation_to_url, None) is None
    assert one(spark, S.citation_to_url, "") is None


def test_slugify_name(spark):
    assert one(spark, S.slugify_name, "Roger B. Taney") == "Roger_B_Taney"
    assert one(spark, S.slugify_name, "Sandra Day O’Connor") == "Sandra_Day_OConnor"
    assert one(spark, S.slugify_name, "José  Núñez-Ruiz ") == "José_Núñez_Ruiz"


def test_birth_year(spark):
    assert one(spark, S.birth_year, "(1745–1829)") == "1745"
    assert one(spark, S.birth_year, "(born 1955)") == "1955"
    assert one(spark, S.birth_year, "") is None
    assert one(spark, S.birth_year, "born c. 1900") is None


def test_canonical_base(spark):
    assert one(spark, S.canonical_base, "Abe_Fortas_v1.txt") == "Abe_Fortas"
    assert one(spark, S.canonical_base, "A-v2") == "A"
    assert one(spark, S.canonical_base, "A_v") == "A_v"


def test_clean_trailing_ws(spark):
    assert one(spark, S.clean_trailing_ws, "a  \n\nb") == "a\nb"


def test_truncate_at_section(spark):
    t = "intro\n=== Early ===\nx\n=== supreme court service ===\ny\n=== Chief Justice ===\nz"
    assert one(spark, S.truncate_at_section, t) == "intro\n=== Early ===\nx"
    assert one(spark, S.truncate_at_section, "no headings") == "no headings"


def test_year_from_id(spark):
    assert one(spark, S.year_from_id, "1946-001") == 1946
    assert one(spark, S.year_from_id, "19") == 19
    assert one(spark, S.year_from_id, "abcd") == 0


def test_split_tenure(spark):
    r = one(spark, S.split_tenure, "1801 – 1835 (Died)")
    assert (r["tenure_start"], r["tenure_end"], r["tenure_status"]) == ("1801", "1835", "Died")
    r = one(spark, S.split_tenure, "no dash")
    assert (r["tenure_start"], r["tenure_end"], r["tenure_status"]) == ("", "", "")


def test_parse_votes(spark):
    r = one(spark, S.parse_votes, "A:1; B:2;  ; A:8; C:1")
    assert r == ["A", "B", "C"]


def test_word_count(spark):
    assert one(spark, S.word_count, "  a b ") == 2


def test_decode_codes(spark):
    from docket.functions import codebooks as cb
    df = spark.createDataFrame([("1", None), ("2", "27.0"), ("3", "x"), ("4", "9999")], "k string, v string")
    out = decode.decode_codes(df, "v", cb.book_df(spark, cb.PETITIONER_CODES), "dflt", "lab")
    got = {r["k"]: r["lab"] for r in out.collect()}
    assert got == {"1": "Not specified", "2": "United States", "3": "dflt", "4": "dflt"}


def test_vote_shares(spark):
    df = spark.createDataFrame([(3, 5, 4), (2, 5, 4), (10, 5, 4), (None, 5, 4), (3, 6, 4)], "d int, a int, b int")
    v = df.select(vote_counts(F.col("d"), F.col("a"), F.col("b")).alias("v")).collect()
    got = [(r.v.pct_in_favor, r.v.pct_against, r.v.pct_absent) for r in v]
    assert got[0] == (5 / 9, 4 / 9, 0.0)
    assert got[1] == (4 / 9, 5 / 9, 0.0)
    assert got[2] == (-1.0, -1.0, -1.0) and got[3] == (-1.0, -1.0, -1.0)
    assert math.isclose(got[4][2], -1 / 9)


def test_normalize_target_and_argmax(spark):
    df = spark.createDataFrame([([-1.0, -1.0, -1.0],), ([5 / 9, 4 / 9, 0.0],), ([1.0, 3.0, 3.0],)], "t array<double>")
    r = df.select(A.normalize_target(F.col("t")).alias("n"), A.argmax(F.col("t")).alias("a")).collect()
    assert [round(x, 9) for x in r[0].n] == [round(1 / 3, 9)] * 3
    assert r[1].n == [5 / 9, 4 / 9, 0.0]
    assert r[2].a == 1  # first on ties


def test_kl_equal_logits(spark):
    df = spark.createDataFrame([([0.0, 0.0, 0.0], [0.5, 0.5, 0.0])], "p array<double>, t array<double>")
    kl = df.select(A.kl_row(F.col("p"), F.col("t")).alias("k")).collect()[0].k
    expect = 0.5 * math.log(0.5) * 2 + math.log(3)
    assert math.isclose(kl, expect, rel_tol=1e-12)
