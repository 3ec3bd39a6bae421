"""Steps that must not cost more per row as tables grow: results on small rows, and what the plan holds."""

from pyspark.sql import functions as F

from docket.functions import arrays as A
from docket.operators import augment, leakage, records, reports, tally, tokens

TOKENS = "key string, input_ids array<int>, attention_mask array<int>"
RECORD = "case_id string, bios array<string>, description string, target array<double>"


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_field_in_order_of_entries(spark):
    df = spark.createDataFrame([(1, [(2, "b"), (1, "z"), (None, "n"), (2, "a")]), (2, []), (3, None)], "id int, e array<struct<o:int,v:string>>")
    got = {r.id: r.v for r in df.select("id", A.in_order(F.col("e"), "v").alias("v")).collect()}
    assert got == {1: ["n", "z", "a", "b"], 2: [], 3: None}


def test_votes_and_records_are_ordered_without_a_lambda(spark):
    votes = spark.createDataFrame([("c", 2, "B", 1), ("c", 1, "A", 2)], "caseIssuesId string, pos int, justiceName string, vote int")
    votes = votes.select("*", *[F.lit("1").alias(c) for c in ("usCite", "chief", "caseName")],
                         *[F.lit(1).alias(c) for c in tally.CASE_ATTRS if c not in ("usCite", "chief", "caseName")])
    cases = tally.vote_tally(votes, ["pos"])
    assert cases.head().justice_votes == "A:2; B:1" and "array_sort" not in optimized(cases)
    # a member listed twice, blanks of all kinds, no code, a code without a vote
    book = spark.createDataFrame([("A", "Ann"), ("A", "Ann"), ("B", "Bo"), ("C", "Cy")], "code string, name string")
    bios = spark.createDataFrame([("Ann",), ("Ann",), ("Bo",), ("Cy",)], "key string")
    rows = spark.createDataFrame([("c", "1 U.S. 1", 0.5, 0.5, 0.0, "\t B:1:9 \n;;  ; :3;C\r; A:2;B:1")],
                                 "caseIssuesId string, usCite string, pct_in_favor double, pct_against double, pct_absent double, justice_votes string")
    desc = spark.createDataFrame([("x",)], "file_key string")
    got = records.assemble_training_records(rows, book, bios, desc)
    assert [b.split("/")[-1] for b in got.head().bios] == ["Bo.txt", "Cy.txt", "Ann.txt"] and "array_sort" not in optimized(got)


def test_only_described_records_gather_tokens(spark):
    recs = spark.createDataFrame([("a", ["d/x.txt", "d\\y.txt", "d/none.txt"], "t\\a.txt", [1.0]), ("b", ["d/x.txt"], None, [1.0]),
                                  ("c", ["d/x.txt", "d/y.txt"], "t/none.txt", [1.0]), ("d", ["d/none.txt"], "t/a.txt", [1.0]), ("e", [], "t/a.txt", [1.0])], RECORD)
    bios = spark.createDataFrame([("k/x.txt", [1], [1]), ("k\\y.txt", [2, 3], [1, 1])], TOKENS)
    desc = spark.createDataFrame([("k/a.txt", [7, 8], [1, 1])], TOKENS)
    kept, skipped = tokens.join_tokens_by_basename(recs, bios, desc)
    row = kept.collect()
    assert [(r.case_id, r.justice_count, [m.input_ids for m in r.members], r.case_tokens.input_ids) for r in row] == [("a", 2, [[1], [2, 3]], [7, 8])]
    got = {r.case_id: (r.reason, r.justice_count, len(r.members or [])) for r in skipped.collect()}
    assert got == {"b": ("no description", 1, 0), "c": ("description not tokenized", 2, 2), "d": ("no valid justice biographies found", 0, 0),
                   "e": ("no valid justice biographies found", 0, 0)}
    # the members' tokens are gathered only where somebody reads them
    assert "collect_list" not in optimized(skipped.groupBy("reason").count()) and "collect_list" in optimized(kept)


def test_references_are_counted_in_one_pass(spark):
    recs = spark.createDataFrame([("a", ["d/x.txt", "d/y.txt"], "t/a.txt", [1.0]), ("b", ["d/x.txt", "e/x.txt", None], None, [1.0]),
                                  ("c", [], "t/z.txt", [1.0]), ("d", None, "t/a.txt", [1.0])], RECORD)
    source = recs.join(spark.range(3, 4), F.lit(True))  # a step that must run once
    u = reports.unique_references(source)
    assert tuple(u.head()) == (3, 4, 2, 3) and optimized(u).count("Range (") == 1
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    m = augment.missing_references(source, keys("k\\x.txt", "k/x.txt"), keys("k/a.txt"))
    assert {r.kind: (r.n_refs, r.n_missing) for r in m.collect()} == {"bio": (5, 2), "description": (3, 1)}
    assert optimized(m).count("Range (") == 1


def test_versions_of_records_without_a_description(spark):
    recs = spark.createDataFrame([("a", ["d/x.txt", "d/y.txt"], "t/a.txt", [1.0]), ("b", ["d/y.txt"], None, [1.0]), ("c", [], "t/z.txt", [1.0])], RECORD)
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    e = augment.expand_versions(recs, keys("x_v1.txt", "x_v0.txt", "y_v0.txt", "x_v10.txt"), keys("a_v0.txt"), "b/", "d/")
    assert {r.case_id: (r.bios, r.description) for r in e.collect()} == {
        "a": (["b/x_v0.txt", "b/x_v1.txt", "b/y_v0.txt"], "d/a_v0.txt"), "b": (["b/y_v0.txt"], None), "c": ([], None)}
    assert "array_sort" not in optimized(e) and "concat(/, case_id" in optimized(e)


def test_large_vocabulary_in_two_parts(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i, 40) for _ in range(3))) for i in range(40)] + [(None, "w39 zzz w1"), (90, ""), (91, None), (7, "w3 w0")]
    docs = spark.createDataFrame(rows, "id int, text string")
    vocab = tokens.build_vocab(docs.filter("id < 40")).cache()
    encode = lambda most: {r.key: tuple(r)[1:] for r in tokens.tokenize_encode(docs, "id", "text", vocab, 64, most).collect()}
    whole = encode(1 << 20)
    assert len(whole) == 43 and whole[90][1] == [tokens.CLS, tokens.SEP] and whole[None][1][2] == tokens.UNK
    assert encode(200) == whole and encode(0) == whole


def test_outcome_words_are_counted_in_one_pass(spark):
    docs = spark.createDataFrame([(i, "The court held so. A cat sat." if i % 2 else "A cat sat on the mat.") for i in range(40)], "id int, text string")
    weights, prior = leakage.outcome_words(docs, "text")
    assert {r.word for r in weights.collect()} >= {"court", "held"} and -1.0 < prior < 0.0
    assert "Generate" not in optimized(weights)  # read from the stored counts, not counted again
    kept = leakage.learnt_filter(docs, "id", "text", weights, prior)
    assert {r.filtered for r in kept.collect()} == {"A cat sat.", "A cat sat on the mat."}


def test_only_described_records_reach_the_tokens(spark):
    cases = spark.createDataFrame([("a", "1 U.S. 1", "A:1;B:2"), ("b", None, "A:1"), ("c", "2 U.S. 2", "B:1;A:1"), ("d", "1 U.S. 1", "Z:1"), (None, "1 U.S. 1", "A:1")],
                                  "caseIssuesId string, usCite string, justice_votes string")
    cases = cases.select("*", *[F.lit(0.5).alias(c) for c in ("pct_in_favor", "pct_against", "pct_absent")])
    book = spark.createDataFrame([("A", "Ann"), ("B", "Bo")], "code string, name string")
    recs = records.assemble_training_records(cases, book, spark.createDataFrame([("Ann",), ("Bo",)], "key string"),
                                             spark.createDataFrame([("1_U.S._1",)], "file_key string"))
    bios = spark.createDataFrame([("k/Ann.txt", [1], [1]), ("k\\Bo.txt", [2, 3], [1, 1])], TOKENS)
    kept, _ = tokens.join_tokens_by_basename(recs, bios, spark.createDataFrame([("k/1_U.S._1.txt", [7], [1])], TOKENS))
    assert [(r.case_id, [m.input_ids for m in r.members], r.justice_count, r.case_tokens.input_ids, r.description.split("/")[-1]) for r in kept.collect()] == [
        ("a", [[1], [2, 3]], 2, [7], "1_U.S._1.txt")]
    # cases and descriptions meet in an inner join below the votes, which are exploded once
    tree = optimized(kept)
    assert tree.count("posexplode(split") == 1 and "Join Inner" in tree[tree.index("posexplode(split"):]


def test_kept_rows_of_repeated_and_missing_case_ids(spark):
    recs = spark.createDataFrame([("a", ["d/x.txt"], "t/a.txt", [1.0]), ("a", [], "t/b.txt", [2.0]), (None, ["d/x.txt"], "t/a.txt", [1.0]),
                                  ("b", None, "t/a.txt", [1.0]), ("c", ["d/y.txt", None, "d/x.txt", "d/x.txt"], "t/a.txt", [1.0])], RECORD)
    bios = spark.createDataFrame([("k/x.txt", [1], [1]), ("j/x.txt", [9], [1])], TOKENS)
    kept, _ = tokens.join_tokens_by_basename(recs, bios, spark.createDataFrame([("k/a.txt", [7], [1]), ("k/b.txt", [8], [1])], TOKENS))
    assert sorted((r.case_id, r.description, r.justice_count, [m.input_ids for m in r.members], r.case_tokens.input_ids, r.target) for r in kept.collect()) == [
        ("a", "t/a.txt", 1, [[9]], [7], [1.0]), ("a", "t/b.txt", 1, [[9]], [8], [2.0]), ("c", "t/a.txt", 2, [[9], [9]], [7], [1.0])]
