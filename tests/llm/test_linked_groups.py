import random

import pytest

from claimloom.llm.linked_groups import linked_groups


def brute(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {n: find(n) for n in root}


def run(spark, links, kind="string"):
    rows = [(a, b, 0) for a, b in links]
    got = linked_groups(spark.createDataFrame(rows, f"u {kind}, v {kind}, parent int")).collect()
    assert len(got) == len({r["node"] for r in got})
    return {r["node"]: r["group_key"] for r in got}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    links = [(f"n{rng.randrange(300):03}", f"n{rng.randrange(300):03}") for _ in range(170)]
    links += [(b, a) for a, b in links[:40]] + links[:20] + [(None, "n001"), ("n002", None), (None, None), ("z", "z")]
    assert run(spark, links) == brute(links)


def test_long_chain_and_hub(spark):
    order = list(range(400))
    random.Random(3).shuffle(order)
    chain = list(zip(order, order[1:], strict=False))
    hub = [(1000 + i, 5000) for i in range(500)]
    assert run(spark, chain + hub, "long") == brute(chain + hub)


def test_empty_and_only_self_links(spark):
    assert run(spark, []) == {}
    assert run(spark, [("a", "a"), (None, "b")]) == {}


def test_every_claim_and_segment_has_a_group(spark, monkeypatch):
    from claimloom.llm import queries

    tables = {
        "extracted_claims": spark.createDataFrame([("x1", "s1"), ("x2", None), ("x3", "s9"), ("x3", "s9")], "claim_id string, segment_id string"),
        "merge_results": spark.createDataFrame([({"u": ["s1", "s2"], "v": ["s3", None]},), ({"w": None},), (None,)], "unit_segments map<string, array<string>>"),
    }
    found = spark.createDataFrame([("claim", "x1", "x0"), ("claim", "x0", "x0"), ("segment", "s1", "s1"), ("segment", "s2", "s1")], "node_kind string, node_key string, group_key string")
    monkeypatch.setattr(queries, "read_table", lambda spark, d, name: tables[name])
    monkeypatch.setattr(queries, "p7_found", lambda spark, d: found)
    got = sorted(tuple(r) for r in queries.p7_groups(spark, "").collect())
    assert got == [("claim", "x0", "x0"), ("claim", "x1", "x0"), ("claim", "x2", "x2"), ("claim", "x3", "x3"), ("segment", "s1", "s1"), ("segment", "s2", "s1"), ("segment", "s3", "s3"), ("segment", "s9", "s9")]
