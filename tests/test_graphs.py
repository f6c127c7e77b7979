import random

import pytest
from helpers import corpus, edges, units

from claimloom.operators import bundles, graphs, patterns
from claimloom.operators.corpus import Rejected
from claimloom.sources.dot import to_dot


def four(spark):
    return corpus(spark, units=units("a", "b", "c", "d"), relations=edges(("a", "b", "attack", ["w"]), ("b", "a", "attack", ["w"]), ("c", "a", "support", ["w"])))


def test_diagnostics(spark):
    c = four(spark)
    d = graphs.diagnostics(c.units, c.warrants, c.relations).collect()[0].asDict()
    want = {"node_count": 4, "relation_count": 3, "attack_edge_count": 2, "support_edge_count": 1, "cycle_count": 1, "component_count": 2, "scc_count": 3, "isolated_units": 1, "unsupported_claims": 3, "max_in": 2, "max_out": 1, "max_reachability": 2}
    assert {k: d[k] for k in want} == want and d["avg_in"] == 0.75
    e = graphs.project_edges(c.relations)
    reach = {(r["src"], r["dst"]) for r in graphs.reachability(c.units, e).collect()}
    assert reach == {("a", "a"), ("a", "b"), ("b", "a"), ("b", "b"), ("c", "a"), ("c", "b")}


def test_cycles_follow_the_walk():
    assert graphs.back_edge_cycles("ab", [("a", "b"), ("b", "a"), ("a", "a")]) == [["a"], ["a", "b"]]
    assert graphs.back_edge_cycles("abc", [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c")]) == [["a", "b", "c"]]
    deep = [(str(i), str(i + 1)) for i in range(50_000)]
    assert len(graphs.back_edge_cycles([], [*deep, ("50000", "0")])[0]) == 50_001
    assert len(graphs.strong_components([], [*deep, ("50000", "0")])) == 1


@pytest.mark.parametrize("seed", [1])
def test_loops_equal_kernels(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:02}" for i in range(30)]
    many = [[(rng.choice(names), rng.choice([*names, "dangling"]), "support", []) for _ in range(n)] for n in (20, 34, 60)]
    rel = [r | {"graph_id": f"g{g}"} for g, rows in enumerate(many) for r in edges(*rows)]
    c = corpus(spark, units=[u | {"graph_id": f"g{g}"} for g in range(3) for u in units(*names)], relations=rel)
    e = graphs.project_edges(c.relations)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(graphs.weakly_connected(c.units, e)) == rows(graphs.weakly_connected_small(c.units, e))
    assert rows(graphs.strongly_connected(c.units, e)) == rows(graphs.strongly_connected_small(c.units, e))
    plain = [[(r[0], r[1]) for r in g] for g in many]
    assert rows(graphs.reachability(c.units, e)) == sorted((f"g{g}", s, d) for g, p in enumerate(plain) for s, ds in graphs.reachable(names, p).items() for d in ds)
    assert rows(graphs.cycles(c.units, e)) == sorted((f"g{g}", i, x) for g, p in enumerate(plain) for i, x in enumerate(graphs.back_edge_cycles(names, p)))
    d = {r["graph_id"]: r for r in graphs.diagnostics(c.units, c.warrants, c.relations).collect()}
    assert {g: r["max_reachability"] for g, r in d.items()} == {f"g{g}": max(map(len, graphs.reachable(names, p).values())) for g, p in enumerate(plain)}


def test_long_chain_and_ring(spark):
    n = 60
    order = list(range(n))
    random.Random(4).shuffle(order)
    ring = [(f"r{a:03}", f"r{b:03}", "support", []) for a, b in zip(order, order[1:] + order[:1], strict=True)]
    chain = [(f"s{a:03}", f"s{b:03}", "support", []) for a, b in zip(order, order[1:], strict=False)]
    c = corpus(spark, relations=edges(*ring, *chain, ("r000", "s000", "support", [])))
    e = graphs.project_edges(c.relations)
    strong = {r["node"]: r["component"] for r in graphs.strongly_connected(c.units, e).collect()}
    assert {strong[f"r{i:03}"] for i in range(n)} == {"r000"} and all(strong[f"s{i:03}"] == f"s{i:03}" for i in range(n))
    assert {r["component"] for r in graphs.weakly_connected(c.units, e).collect()} == {"r000"}


def test_empty(spark):
    c = corpus(spark)
    e = graphs.project_edges(c.relations)
    for f in (graphs.weakly_connected, graphs.strongly_connected, graphs.reachability, graphs.cycles, graphs.degrees):
        assert f(c.units, e).collect() == []
    assert graphs.diagnostics(c.units, c.warrants, c.relations).collect() == []


def found(df):
    return {(r["pattern_id"], tuple(r["nodes"]), tuple(r["edges"])) for r in df.collect()}


def test_patterns(spark):
    u = units("a", "b", "c", "d")
    u[0]["text"], u[2]["text"] = "Same  Text", " same text\n"
    rel = edges(("a", "b", "support", []), ("a", "a", "attack", ["w"]), ("c", "b", "support", ["w"]), ("a", "b", "attack", ["w"]), ("b", "d", "support", ["w"]), ("d", "b", "support", ["w"]))
    m = patterns.detect_patterns(corpus(spark, units=u).units, corpus(spark, relations=rel).relations)
    assert found(m) == {
        ("circular_reasoning", ("b", "d"), ("e4", "e5")), ("self_attack", ("a",), ("e1",)), ("unstated_warrant", ("a", "b"), ("e0",)), ("unsupported_conclusion", ("a",), ()),
        ("unsupported_conclusion", ("c",), ()), ("redundancy", ("a", "b", "c"), ()), ("contradiction", ("a", "b"), ("e0", "e3")),
    }
    order = [r["pattern_id"] for r in patterns.numbered(m).orderBy("match_ord").collect()]
    assert order == ["circular_reasoning", "unstated_warrant", "self_attack", "unsupported_conclusion", "unsupported_conclusion", "redundancy", "contradiction"]
    after = {r["edge_idx"]: (r["gate_disabled"], r["gate_action"]) for r in patterns.apply_gate_actions(corpus(spark, relations=rel).relations, m).collect()}
    assert after[0] == (True, "unstated_warrant") and after[1] == (True, "self_attack") and after[4] == (True, "circular_reasoning") and after[2] == (None, None)


def test_restrict_edge(spark):
    rel = corpus(spark, relations=edges(("a", "b", "support", []))).relations
    bank = [(p[0], *p[1:4], "restrict_edge", p[5]) if p[0] == "unstated_warrant" else p for p in patterns.pattern_bank()]
    m = patterns.detect_patterns(corpus(spark, units=units("a", "b")).units, rel, bank)
    r = patterns.apply_gate_actions(rel, m).collect()[0]
    assert r["gate_mode"] == "AND" and r["gate_restricted"] and r["gate_action"] == "unstated_warrant"


def test_bundles(spark):
    rel = edges(("a", "b", "support", [], "OR", 0.5), ("c", "d", "support", []), ("b", "c", "attack", [], "OR", 0.8))
    c = corpus(spark, units=units("a", "b", "c", "d"), relations=rel)
    new = corpus(spark, bundles=[{"ord": 0, "units": ["a", "b"]}, {"ord": 1, "units": ["c", "d"]}]).bundles
    all_b = bundles.define_bundles(c.bundles, new, c.units)
    members = bundles.bundle_members(all_b)
    assert sorted((r["bundle_id"], r["edge_idx"]) for r in bundles.bundle_relations(members, c.relations).collect()) == [("arg_1", 0), ("arg_2", 1)]
    got = bundles.project_bundles(members, c.relations).collect()
    assert [(r["src"], r["dst"], r["kind"], r["weight"]) for r in got] == [("arg_1", "arg_2", "attack", -0.8)]
    with pytest.raises(Rejected, match="two units"):
        bundles.define_bundles(c.bundles, corpus(spark, bundles=[{"ord": 0, "units": ["a"]}]).bundles, c.units)
    with pytest.raises(Rejected, match="unknown unit"):
        bundles.define_bundles(c.bundles, corpus(spark, bundles=[{"ord": 0, "units": ["a", "z"]}]).bundles, c.units)
    with pytest.raises(Rejected, match="several bundles"):
        bundles.project_bundles(bundles.bundle_members(bundles.define_bundles(all_b, corpus(spark, bundles=[{"ord": 2, "units": ["a", "c"]}]).bundles, c.units)), c.relations)
    with pytest.raises(ValueError, match="no bundles"):
        bundles.project_bundles(members.where("false"), c.relations)


@pytest.mark.parametrize(("how", "want"), [("sum", 0.5), ("mean", 0.25), ("max", 1.0), ("softmax", 0.433689)])
def test_aggregations(spark, how, want):
    rel = edges(("a", "b", "support", [], "OR", 1.0), ("a", "b", "attack", [], "OR", 0.5))
    c = corpus(spark, units=units("a", "b"), relations=rel)
    members = c.units.selectExpr("graph_id", "unit_id", "concat('b', unit_id) AS bundle_id")
    assert bundles.project_bundles(members, c.relations, how).collect()[0]["weight"] == pytest.approx(want, abs=1e-6)


def test_dot(spark):
    u = units("c1")
    u[0]["text"] = 'say "x"\n\\'
    c = corpus(spark, units=u, relations=edges(("c1", "c1", "undercut", [])))
    assert to_dot(c.units, c.relations).collect()[0]["dot"].split("\n") == [
        "digraph ArgumentGraph {", "  node [shape=box];", '  "c1" [label="c1: say \\"x\\"\\n\\\\"];', '  "c1" -> "c1" [label="undercut", color="orange"];', "}",
    ]
