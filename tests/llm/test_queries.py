import os

import pytest

from claimloom.llm import queries

DATA = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def tables():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


@here
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, tables, name):
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    want = tables.execute(f"SELECT {', '.join(cols)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.select(*cols).collect()) != []


@here
def test_packing_holds_every_text_once(spark):
    sizes = {r["doc_id"]: len(r["ids"]) for r in queries.p8_ids(spark, DATA).collect()}
    rows = queries.p9_packing(spark, DATA).collect()
    placed, held = dict.fromkeys(sizes, 0), {}
    for r in rows:
        placed[r["doc_id"]] += r["length"]
        if r["length"]:
            held.setdefault(r["container_id"], []).append((r["start"], r["length"]))
    assert placed == sizes and all(len([r for r in rows if r["doc_id"] == k]) == max(1, -(-n // queries.CAPACITY)) for k, n in sizes.items())
    for items in held.values():
        items.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(items, items[1:], strict=False)) and items[-1][0] + items[-1][1] <= queries.CAPACITY
    assert len(held) == -(-sum(sizes.values()) // queries.CAPACITY)


@here
def test_normal_forms_of_the_tables(spark):
    from claimloom.llm.lookalikes import normalise

    texts = {r["doc_id"]: r["text"] for r in queries.read_table(spark, DATA, "documents").select("doc_id", "text").collect()}
    assert {r["doc_id"]: r["normal"] for r in queries.p10_normal(spark, DATA).collect()} == {k: None if t is None else normalise(t) for k, t in texts.items()}


def test_sql_is_for_queries():
    assert set(queries.SQL) <= set(queries.QUERIES)
