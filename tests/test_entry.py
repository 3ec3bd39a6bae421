"""Driver contract and DuckDB oracle agreement at sf0.001."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from paths import SF0001
from tools_check import table_hash

FAST = ["vote_tally", "assemble_training_records", "decode_codes", "render_case_outcome", "holdout_most_recent",
        "split_time_train_val", "cv_forward_folds", "f1_macro", "kl_loss", "mrr", "cluster_cohesion",
        "tokenize_encode", "parse_doc_header", "clean_biography", "upsert_new_wins", "incremental_upsert"]


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "justice_votes" in df.columns


def test_every_oracle_has_a_query():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 140


@pytest.fixture(scope="module")
def duck():
    from docket.sources.tables import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    return con


KEYS = list(entry.oracle_sql()) if os.environ.get("DOCKET_FULL") else FAST


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, duck, key):
    sdf = entry.queries()[key](spark, SF0001)
    srows = [tuple(r) for r in sdf.collect()]
    cur = duck.execute(entry.oracle_sql()[key])
    dcols = [c[0] for c in cur.description]
    drows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert table_hash(sdf.columns, srows)[0] == table_hash(dcols, drows)[0]
