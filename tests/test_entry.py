import os

import pytest

import __spark_entry__ as e

DATA = "/root/testdata/sf0.001"


def test_every_sql_text_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_entry_runs(spark):
    assert e.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["copresence_degree", "next_window_rates", "disclosure_full", "latest_version", "scored_search", "script_share"])
def test_queries_agree_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    sql = e.oracle_sql().get(name)
    got = e.queries()[name](spark, DATA)
    if sql is None:
        assert got.count() > 0
        return
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    want = con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns) and got.count() == len(want)
