"""Findings of round 2: how the work is done, beside what comes out."""

import random

from claimloom.operators import graphs, mining, reconcile
from helpers import corpus, edges, units


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_mined_once_and_moved_once(spark):
    df = spark.createDataFrame([(1, "One. Two!\n\none.  Three"), (2, None), (None, "Five.")], "doc_id int, text string")
    mined = mining.mine_long(df, "doc_id", "text")
    plan = _plan(mined)
    assert plan.count("MapInPandas") == 2 and plan.count("Exchange") == 1 and "Broadcast" not in plan
    got = sorted((r["doc_id"], r["new_id"], r["text"], r["source_unit_ids"], [tuple(s) for s in r["spans"]], r["segments"]) for r in mined.collect())
    assert got == [(1, "c1", "One.", ["c1", "c1"], [(0, 4), (11, 15)], 2), (1, "c2", "Two!", ["c2"], [(4, 9)], 1), (1, "c3", "Three", ["c2"], [(15, 22)], 1)]


def _random_graph(n, m, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(n)]
    return names, [(rng.choice(names), rng.choice(names)) for _ in range(m)]


def test_figures_of_a_walk_are_those_of_its_lists(monkeypatch):
    monkeypatch.setattr(graphs, "REACH_BITS", 3)
    for seed in range(150):
        names, pairs = _random_graph(seed % 13 + 1, seed % 29, seed)
        out = graphs._index(names, pairs)[1]
        reach = graphs.reachable(names, pairs)
        assert sorted(graphs.reach_sizes(out)) == sorted((len(p), len(reach[p[0]])) for p in graphs.strong_components(names, pairs))
        assert graphs.back_edges(out) == len(graphs.back_edge_cycles(names, pairs))


def test_diagnostics_list_neither_pairs_nor_cycles(spark, monkeypatch):
    names, pairs = _random_graph(30, 40, 7)
    c = corpus(spark, units=units(*names, "alone"), relations=edges(*[(s, d, "support", []) for s, d in pairs]))
    for listing in ("condensation", "cycles", "strongly_connected"):
        monkeypatch.setattr(graphs, listing, None)
    (d,) = graphs.diagnostics(c.units, c.warrants, c.relations).collect()
    reach = graphs.reachable(names, pairs)
    assert d["max_reachability"] == max(map(len, reach.values())) and d["cycle_count"] == len(graphs.back_edge_cycles(names, pairs))
    assert d["scc_count"] == len(graphs.strong_components(names, pairs)) + 1 and d["component_count"] == len(graphs.weak_components(names, pairs)) + 1


def test_similar_pairs_compare_few_sets_and_miss_none(spark):
    rng = random.Random(3)
    often, rare = [f"t{i}" for i in range(6)], [f"r{i}" for i in range(40)]
    texts = {" ".join(rng.sample(often, rng.randint(0, 6)) + rng.sample(rare, rng.randint(0, 3))) for _ in range(150)}
    texts |= {" ".join(t.split()[1:] + ["r1"]) for t in list(texts)[:40]} | {"one", "two", ""}
    keys = spark.createDataFrame([("d", i, i, t) for i, t in enumerate(sorted(texts))], "doc_id string, key long, at int, text string")
    by = dict(enumerate(sorted(texts)))
    for threshold in (0.8, 0.4):
        got = {(r["a"], r["b"]): round(r["score"], 9) for r in reconcile.similar_pairs(keys, threshold).collect()}
        want = {(a, b): round(s, 9) for a in by for b in by if a < b and (s := reconcile.jaccard(by[a], by[b])) >= threshold}
        assert got == want and want


def test_only_similar_keys_are_decided_in_rounds(spark, monkeypatch):
    texts = [f"w{i} x{i} y{i} z{i}" for i in range(20)] + ["w1 x1 y1 z1 v"]
    rows = spark.createDataFrame([("d", (i,), t) for i, t in enumerate(texts)], "doc_id string, at struct<n: int>, key string")
    asked, plain = [], reconcile.kept_keys

    def counting(keys, pairs):
        asked.append(keys.count())
        return plain(keys, pairs)

    monkeypatch.setattr(reconcile, "kept_keys", counting)
    got = {r["at"]["n"]: (r["root"], r["score"]) for r in reconcile.joined_keys(rows, reconcile.jaccard, 0.8, True).collect()}
    assert asked == [2] and got == {i: (t, None) for i, t in enumerate(texts[:20])} | {20: (texts[1], 0.8)}


def test_reachability_takes_strong_components_from_one_walk(spark, monkeypatch):
    names, pairs = _random_graph(20, 28, 5)
    c = corpus(spark, units=units(*names, "alone"), relations=edges(*[(s, d, "support", []) for s, d in pairs]))
    monkeypatch.setattr(graphs, "strongly_connected", None)
    got = {(r["src"], r["dst"]) for r in graphs.reachability(c.units, graphs.project_edges(c.relations)).collect()}
    assert got == {(s, d) for s, ds in graphs.reachable(names, pairs).items() for d in ds}
