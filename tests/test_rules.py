"""Hand-written expectations for rules that the shared fixtures cannot catch."""

import json
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docket.operators import html, leakage, metrics, records, similar_words, tally, tokens
from docket.session import scratch_path
from docket.sources import files
from docket.streaming import incremental


def test_first_record_per_case_wins_whole(spark):
    cases = spark.createDataFrame(
        [("c1", "9 U.S. 1", 0.5, 0.5, 0.0, "A:1; B:2", 1), ("c1", "1 U.S. 1", 1.0, 0.0, 0.0, "C:1", 2),
         ("c2", None, -1.0, -1.0, -1.0, "", 3)],
        "caseIssuesId string, usCite string, pct_in_favor double, pct_against double, pct_absent double, justice_votes string, o int")
    book = spark.createDataFrame([(c, f"Member {c}") for c in "ABC"], "code string, name string")
    bios = spark.createDataFrame([(f"Member {c}",) for c in "ABC"], "key string")
    desc = spark.createDataFrame([("1_U.S._1",)], "file_key string")
    got = {r.case_id: r for r in records.assemble_training_records(cases, book, bios, desc, ["o"]).collect()}
    assert [b.split("/")[-1] for b in got["c1"].bios] == ["Member A.txt", "Member B.txt"]
    assert got["c1"].description is None and got["c1"].target == [0.5, 0.5, 0.0]
    assert got["c2"].bios == [] and got["c2"].target == [-1.0, -1.0, -1.0]


def test_hot_case_is_tallied_by_chunks(spark):
    votes = spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("c"), (F.col("id") % 700).cast("string"))).alias("caseIssuesId"),
        F.col("id").alias("pos"), F.concat(F.lit("J"), F.col("id").cast("string")).alias("justiceName"), F.lit(1).alias("vote"),
        *[F.col("id").cast("string").alias(c) for c in ("usCite", "chief", "caseName")],
        *[F.col("id").cast("int").alias(c) for c in tally.CASE_ATTRS if c not in ("usCite", "chief", "caseName")])
    cols = ["caseIssuesId", "usCite", "total_justices_voting", "justice_votes"]
    whole = tally.vote_tally(votes, ["pos"]).select(cols)
    parts = tally.vote_tally(votes, ["pos"], chunk=F.floor(F.col("pos") / 64)).select(cols)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))
    hot = {r.caseIssuesId: r for r in parts.collect()}["hot"]
    assert hot.total_justices_voting == 1000 and hot.justice_votes == "; ".join(f"J{i}:1" for i in range(0, 3000, 3)) and hot.usCite == "0"


def test_member_of_a_versioned_file(spark):
    pairs = spark.createDataFrame([("Ann_Lee_v1.txt", "Ann_Lee_v1.txt"), ("Bo_Ray-v2.txt", "Bo_Ray.txt"), ("Nobody.txt", "Nobody.txt")],
                                  "trunc_key string, full_key string")
    members = spark.createDataFrame([("Ann Lee", "May 4, 1950", "P1"), ("Bo Ray", "June 1, 1961", "P2")],
                                    "name string, appointment_date string, nominated_by string")
    got = {r.trunc_key: (r.year, r.president) for r in tokens.enrich_with_metadata(pairs, members).collect()}
    assert got == {"Ann_Lee_v1.txt": (1950, "P1"), "Bo_Ray-v2.txt": (1961, "P2"), "Nobody.txt": (None, None)}


@pytest.mark.parametrize("chunk", [2, 1 << 20])
def test_early_stop(spark, chunk):
    runs = {1: [5, 4, 3, 2, 1, 0], 2: [1, 2, 3, 4, 5, 6, 7], 3: [3, 9, 2, 9, 2, 9, 2, 9, 1]}
    log = spark.createDataFrame([(r, e, float(v)) for r, vs in runs.items() for e, v in enumerate(vs)], "run int, epoch int, v double")
    got = {r.run: tuple(r)[1:] for r in metrics.early_stop(log, ["run"], "epoch", "v", 3, chunk_rows=chunk).collect()}
    assert got == {1: (5, 5, 0.0, False), 2: (3, 0, 1.0, True), 3: (5, 2, 2.0, True)}
    even = {r.run: tuple(r)[1:] for r in metrics.early_stop(log, ["run"], "epoch", "v", 2, only_even=True, min_epochs=4, chunk_rows=chunk).collect()}
    # run 1 never stops: its last epoch is 5, which is not a counted one
    assert even == {1: (5, 4, 1.0, False), 2: (4, 0, 1.0, True), 3: (6, 2, 2.0, True)}


def test_confusion_grid(spark):
    df = spark.createDataFrame([(0, 0), (0, 5), (2, 1), (2, None), (7, 2)], "t int, p int")
    got = sorted(tuple(r) for r in metrics.confusion_matrix(df, "t", "p", 3).collect())
    assert got == [(0, 1, 0, 0, 1), (1, 0, 0, 0, 0), (2, 0, 1, 0, 1), (7, 0, 0, 1, 0)]


def test_vocabulary_has_no_cap(spark):
    docs = spark.range(0, 400).select("id", F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.concat(
        F.lit("t"), (F.col("id") * 100 + i).cast("string")))).alias("text"))
    vocab = tokens.build_vocab(docs).cache()
    assert vocab.count() == 40_000 and vocab.select("id").distinct().count() == 40_000
    ids = tokens.tokenize_encode(docs, "id", "text", vocab)
    assert ids.filter(F.array_contains("input_ids", tokens.UNK)).count() == 0 and ids.filter("n_tokens <> 100").count() == 0


def test_context_lexicon_does_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, f"the cat{i % 5} sat on the mat{i % 3} and the dog{i % 7} ran") for i in range(60)], "id int, text string")
    old, out = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("4", "16", "4"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out.append(sorted(map(tuple, similar_words.similar_words(docs.repartition(int(n)), "text").collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert out[0] == out[1] == out[2] and out[0]


STORE = T.StructType([T.StructField("key", T.LongType()), T.StructField("text", T.StringType())])


def store_of(spark, store):
    return {r.key: r.text for r in incremental.latest_store(spark, store, STORE).collect()}


def test_upsert_can_be_replayed(spark):
    store = scratch_path(spark, "store")
    rows = lambda xs: spark.createDataFrame(xs, "key long, text string, ord long")
    first = rows([(1, "a", 1), (2, "b", 1), (None, "n", 1)])
    second = rows([(2, "z old", 1), (2, "a new", 2), (3, "c", 1), (None, "n new", 1)])
    incremental.upsert_batch(first, 0, store, STORE, ["key"], ["ord"], share=100.0)
    for _ in range(2):  # the second batch again, as after a lost commit entry
        incremental.upsert_batch(second, 1, store, STORE, ["key"], ["ord"], share=100.0)
        assert store_of(spark, store) == {1: "a", 2: "a new", 3: "c", None: "n new"}
    assert incremental.compact(spark, store, STORE, ["key"], share=0.0)
    incremental.upsert_batch(second, 1, store, STORE, ["key"], ["ord"])  # the base holds it
    assert store_of(spark, store) == {1: "a", 2: "a new", 3: "c", None: "n new"}


def test_a_batch_writes_its_own_rows(spark):
    store = scratch_path(spark, "store")
    text = lambda i: "".join(chr(97 + (i * k * k + i) % 26) for k in range(40))
    want = {}
    for batch in range(6):
        keys = range(4000) if not batch else range(batch * 7, batch * 7 + 5)
        rows = [(k, f"{batch} {text(k)}", 1) for k in keys]
        want |= {k: t for k, t, _ in rows}
        incremental.upsert_batch(spark.createDataFrame(rows, "key long, text string, ord long"), batch, store, STORE, ["key"], ["ord"])
        assert store_of(spark, store) == want
    names = {kind: files.subfolders(spark, f"{store}/{kind}") for kind in ("base", "delta")}
    assert names["base"] == ["v=00000000"] and len(names["delta"]) == 6
    sizes = [spark.read.parquet(incremental.version_path(store, v)).count() for v in range(1, 6)]
    assert sizes == [5] * 5
    for batch in range(6, 9):  # large increments: new bases, and old folders go
        rows = [(k, f"{batch} {text(k)}", 1) for k in range(4000)]
        want |= {k: t for k, t, _ in rows}
        incremental.upsert_batch(spark.createDataFrame(rows, "key long, text string, ord long"), batch, store, STORE, ["key"], ["ord"])
        assert store_of(spark, store) == want
    assert sorted(files.subfolders(spark, f"{store}/base")) == ["v=00000007", "v=00000008"]
    assert files.subfolders(spark, f"{store}/delta") == ["v=00000008"]


def test_items_are_ingested_once(spark):
    base = scratch_path(spark, "ingest")
    write = lambda xs: spark.createDataFrame(xs, STORE).write.mode("append").parquet(f"{base}/in")
    run = lambda t=None: incremental.incremental_ingest(spark, f"{base}/in", STORE, f"{base}/out", f"{base}/ckpt", ["key"], transform=t)
    found = lambda: sorted((tuple(r) for r in incremental.ingested(spark, f"{base}/out", STORE).collect()), key=repr)
    assert found() == []
    write([(1, "a"), (2, "b"), (2, "a b"), (None, "n")])
    run()
    assert found() == sorted([(1, "a"), (2, "a b"), (None, "n")], key=repr)
    write([(2, "later"), (3, "c"), (None, "later")])
    run(lambda df: df.filter("text <> 'c'"))  # the third item fails
    run()
    assert found() == sorted([(1, "a"), (2, "a b"), (None, "n")], key=repr)
    write([(1, "later"), (3, "c again")])
    run()
    assert found() == sorted([(1, "a"), (2, "a b"), (3, "c again"), (None, "n")], key=repr)
    incremental.ingest_batch(spark.createDataFrame([(1, "later"), (3, "c again")], STORE), 2, f"{base}/out", ["key"], ["text"])  # replayed
    assert found() == sorted([(1, "a"), (2, "a b"), (3, "c again"), (None, "n")], key=repr)


def test_unreadable_store_is_an_error(spark, tmp_path):
    bad = tmp_path / "store" / "delta" / "v=00000000" / "bucket=0"
    bad.mkdir(parents=True)
    (bad / "part-0.parquet").write_text("no parquet")
    (tmp_path / "store" / "delta" / "v=00000000" / "_SUCCESS").touch()
    with pytest.raises(Exception, match="(?i)parquet"):
        incremental.latest_store(spark, str(tmp_path / "store"), STORE).collect()
    assert incremental.latest_store(spark, str(tmp_path / "none"), STORE).count() == 0


def test_json_objects(spark, tmp_path):
    (tmp_path / "cases.json").write_text(json.dumps({"a": [["x.txt"], None, [1, 0, 0]], "b": [[], "d", [-1, -1, -1], {"bio": None}]}, indent=2))
    got = {r.key: json.loads(r.value) for r in files.scan_json_map(spark, str(tmp_path / "cases.json"), None, whole_file=True).collect()}
    assert got == {"a": [["x.txt"], None, [1, 0, 0]], "b": [[], "d", [-1, -1, -1], {"bio": None}]}
    (tmp_path / "bad.json").write_text('{"a": [1,')
    with pytest.raises(Exception):  # noqa: B017
        files.scan_json_map(spark, str(tmp_path / "bad.json"), None, whole_file=True).collect()


PAGE = """<body><nav>menu</nav><div id="mw-content-text"><h2>Life<span class="mw-editsection">[edit]</span></h2><p>Short.</p>
<p>A paragraph of <b>some</b> length<p>An unclosed one of length<ul><li>one<ul><li>inner</li></ul></li><li>two</li></ul>
<dl><dt>term</dt><dt>other</dt><dd>meaning</dd></dl><div class="navbox"><p>navigation that goes</p></div><script>x</script></div></body>"""


def test_sections_of_a_page(spark):
    deep = "<div>" * 3000 + "<p>" * 400 + "deep enough text"
    df = spark.createDataFrame([(1, PAGE), (2, deep), (3, ""), (4, None), (5, "<p>tiny</p>" + "<b>word</b> " * 30)], "page_id long, html string")
    got = {r.page_id: r.text for r in html.html_to_sections(df).collect()}
    assert got[1] == ("=== Life ===\nA paragraph ofsomelength\nAn unclosed one of length\n• one\n• two\n• inner\n"
                      "term: meaning\nother: meaning")
    assert got[2] == "deep enough text" and got[3] == got[4] == "" and got[5] == "tiny" + "word" * 30
    direct = {r.page_id: r.text for r in html.html_to_sections(df, direct=True).collect()}
    assert direct[1] == got[1] and direct[5] == "" and len(direct) == 5


def test_main_content_rules(spark):
    tab = "<div id='tab-opinion-1'>" + "t" * 1200 + "</div><article>" + "a" * 3000 + "</article>"
    short = "<div id='tab-opinion-1'>short</div><article>" + "a" * 300 + "</article>"
    paragraphs = "<body>x<p>" + "p" * 60 + "</p><p>" + "q" * 60 + "</p></body>"
    df = spark.createDataFrame([(1, tab), (2, short), (3, paragraphs), (4, "<body>little</body>"), (5, None)], "page_id long, html string")
    got = {r.page_id: (r.rule, len(r.content)) for r in html.html_main_content(df).collect()}
    assert got == {1: ("tab", 1200), 2: ("selector", 300), 3: ("paragraphs", 122), 4: ("body", 6), 5: ("", 0)}


def test_outcome_words_are_learnt(spark):
    rng = random.Random(5)
    topic = [f"fact{i}" for i in range(60)]
    plain = lambda: "The " + " ".join(rng.choice(topic) for _ in range(6)) + " was argued. "
    # seed terms stand beside words that the list does not have
    seeded = ["The panel affirmed with relief granted below. ", "Relief granted, the petition prevails and the court held so. ",
              "The petition prevails as reversed below. "]
    rows = []
    for i in range(300):
        text = "".join(plain() for _ in range(6)) + (rng.choice(seeded) if i % 2 else "")
        rows.append((i, text + ("Relief granted and the petition prevails." if i % 10 == 0 else "")))
    rows += [(900, None), (901, ""), (902, "No sentence ends here")]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    weights, prior = leakage.outcome_words(docs, "text")
    words = {r.word for r in weights.collect()}
    assert {"relief", "granted", "prevails", "petition"} <= words and not words & set(topic) and "the" not in words and prior < 0
    got = {r.id: r.filtered for r in leakage.learnt_filter(docs, "id", "text", weights, prior).collect()}
    # no seed term is in the planted sentence
    assert leakage.outcome_pattern() and not re.search("held|affirmed|revers", "Relief granted and the petition prevails.")
    left = [i for i in range(0, 300, 10) if "prevails" in got[i]]
    assert len(left) == 0
    for i, text in rows[:300]:
        want = "".join(s for s in re.findall(r"[^.!?]+[.!?]+", text) if "argued" in s).strip()
        assert got[i] == want
    assert got[900] is None and got[901] == "" and got[902] == "No sentence ends here"
    m = leakage.held_out_measure(docs.filter("id % 10 <> 0"), "id", "text").collect()[0]
    assert m.n_sentences > 100 and m.precision == 1.0 and m.recall > 0.95
    none, odds = leakage.outcome_words(docs.limit(0), "text")
    assert none.count() == 0 and odds == 0.0


def test_html_pieces_come_in_bounded_frames():
    pages = pd.DataFrame({"page_id": range(600), "html": ["<body>" + "<p>some text</p>" * 50 + "</body>"] * 600})
    frames = list(html._frames(iter([pages]), "page_id", "html"))
    assert sum(map(len, frames)) == 30_000 and max(map(len, frames)) <= html.AT_ONCE + 50
    assert [p for f in frames for p in f["page_id"].unique()] == list(range(600))
