import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_sql_is_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables here")
def test_entry_and_a_query_against_sql(spark):
    import duckdb

    assert entry.entry(spark).count() > 0
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    for name in ("p4_found", "p4_report", "p2_found", "p6_found", "p1_found", "degrees", "contradiction", "gate_scores", "find_cycles", "broken_payloads", "built_claims", "exported_units"):
        df = entry.queries()[name](spark, DATA)
        cols = sorted(df.columns)
        want = con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
        assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.select(*cols).collect()), name
