import math
import random
from dataclasses import replace

import pytest
from helpers import corpus, edges, units, warrants

from claimloom.operators import scoring
from claimloom.operators.scoring import CREDIBILITY, Reasoner, score_corpus

CARD = [{"card_id": "e1", "ord": 0, "title": "t", "supporting_doc_id": "d1", "excerpt": "x", "confidence": 1.0}]


def sig(x):
    return 1 / (1 + math.exp(-x))


def claims(s):
    return {r["id"]: r["score"] for r in s.claims.collect()}


def ev(i, stance, strength):
    return (i, ("structured", None, "{}"), stance, strength, None)


def base(spark, kind="support", **more):
    u = units("a", "b")
    u[0]["evidence_ids"] = ["e1"]
    w = warrants("w1")
    w[0]["evidence_ids"] = ["e1"]
    return corpus(spark, **{"units": u, "warrants": w, "relations": edges(("a", "b", kind, ["w1"])), "evidence_cards": CARD} | more)


def test_support_and_attack(spark):
    got = score_corpus(base(spark))
    c = claims(got)
    assert c["a"] == pytest.approx(sig(0.5)) and c["b"] == pytest.approx(0.595670, abs=1e-6)
    assert {r["iterations"] for r in got.claims.collect()} == {2}
    assert claims(score_corpus(base(spark, "attack")))["b"] == pytest.approx(0.404330, abs=1e-6)


def test_axioms_and_ignored_influence(spark):
    u = units("a", "b")
    u[0] |= {"is_axiom": True, "score": 1.0}
    w = warrants("w1", is_axiom=True, score=1.0)
    c = corpus(spark, units=u, warrants=w, relations=edges(("a", "b", "support", ["w1"])))
    got = claims(score_corpus(c))
    assert got["a"] == pytest.approx(0.999999, abs=1e-9) and got["b"] == pytest.approx(0.731058, abs=1e-6)
    u[1] |= {"is_axiom": True, "score": -1.0, "ignore_influence": True}
    assert claims(score_corpus(corpus(spark, units=u, warrants=w, relations=edges(("a", "b", "support", ["w1"])))))["b"] == pytest.approx(1e-6)


def test_gates(spark):
    plain = {"units": units("a", "b"), "warrants": warrants("w1")}
    assert claims(score_corpus(corpus(spark, **plain, relations=edges(("a", "b", "support", ["w1"])))))["b"] == pytest.approx(0.562177, abs=1e-6)
    assert claims(score_corpus(corpus(spark, **plain, relations=edges(("a", "b", "support", [])))))["b"] == 0.5
    off = edges(("a", "b", "support", ["w1"]))
    off[0]["gate_disabled"] = True
    assert claims(score_corpus(corpus(spark, **plain, relations=off)))["b"] == 0.5
    attacked = corpus(spark, units=units("a", "b", "c"), warrants=warrants("w1"), relations=edges(("a", "b", "support", ["w1"])), warrant_attacks=[{"attack_idx": 0, "src": "c", "warrant_id": "w1", "kind": "attack"}])
    assert claims(score_corpus(attacked))["b"] == pytest.approx(0.547053, abs=1e-6)
    w = warrants("w1")
    w[0]["evidence_ids"] = ["e1"]
    for mode, want in (("AND", 0.562177), ("OR", 0.577185)):
        c = corpus(spark, units=units("a", "b"), warrants=w, evidence_cards=CARD, relations=edges(("a", "b", "support", ["w1", "w99"], mode)))
        assert claims(score_corpus(c))["b"] == pytest.approx(want, abs=1e-6)


def test_evidence(spark):
    u = units("a", "b", "c", "d")
    u[0]["evidence"] = [ev("x1", "supports", 0.8), ev("x2", "neutral", 1.0), ev("x3", "attacks", 0.2), None]
    u[1]["evidence_ids"] = ["e1", "e9", "e1", None]
    u[2]["evidence"] = [ev("e1", "attacks", 0.0), ev("e1", "supports", 1.0)]
    u[2]["evidence_ids"] = ["e1"]
    u[3]["evidence"] = [ev("x", "supports", None), ev("y", "attacks", 7.0)]
    cards = [CARD[0] | {"confidence": 0.8}]
    docs = [{"doc_id": "d1", "ord": 0, "trust": 0.5}]
    c = corpus(spark, units=u, evidence_cards=cards, supporting_documents=docs)
    got = {r["id"]: r["evidence"] for r in scoring.evidence_support(c.units, "unit_id", c, 0.5).collect()}
    assert got == pytest.approx({"a": 0.2, "b": 0.4, "c": -0.4, "d": 0.0})
    none = corpus(spark, units=u, evidence_cards=[CARD[0] | {"confidence": None}], supporting_documents=[{"doc_id": "d1", "ord": 0, "trust": None}])
    assert {r["id"]: r["evidence"] for r in scoring.evidence_support(none.units, "unit_id", none, 0.5).collect()}["b"] == 0.0


def random_corpus(spark, seed, graphs=4):
    rng = random.Random(seed)
    t = {"units": [], "warrants": [], "relations": [], "warrant_attacks": []}
    for g in range(graphs):
        n = rng.randint(2, 12)
        gid = {"graph_id": f"g{g}"}
        t["units"] += [u | gid | {"is_axiom": rng.random() < 0.2, "score": rng.uniform(-1, 1), "ignore_influence": rng.random() < 0.1, "evidence": [ev("x", rng.choice(["supports", "attacks"]), rng.random())]} for u in units(*[f"c{i}" for i in range(n)])]
        t["warrants"] += [w | gid | {"ignore_influence": rng.random() < 0.1} for w in warrants("w0", "w1", "w2")]
        pick = lambda: rng.choice([f"c{i}" for i in range(n)] + ["gone", None])  # noqa: B023, E731
        t["relations"] += [e | gid for e in edges(*[(pick(), pick(), rng.choice(["support", "attack", "rebut"]), rng.sample(["w0", "w1", "w2", "w9"], rng.randint(0, 3)), rng.choice(["AND", "OR"])) for _ in range(3 * n)])]
        t["warrant_attacks"] += [{"attack_idx": i, "src": pick(), "warrant_id": rng.choice(["w0", "w1", "w9"])} | gid for i in range(3)]
    return corpus(spark, **t)


def test_loop_equals_kernel(spark):
    c = random_corpus(spark, 7)
    cfg = replace(CREDIBILITY, max_iterations=6, epsilon=1e-3)
    a, b = scoring.score_small_graphs(c, cfg), score_corpus(c, cfg)
    for part in ("claims", "warrants"):
        x, y = ({(r["graph_id"], r["id"]): r for r in getattr(s, part).collect()} for s in (a, b))
        assert x.keys() == y.keys()
        for k in x:
            assert x[k]["score"] == pytest.approx(y[k]["score"], abs=1e-12) and x[k]["iterations"] == y[k]["iterations"]


def test_explanations_and_fragility(spark):
    c = base(spark)
    s = score_corpus(c)
    e = scoring.explanations(c, s).collect()
    assert [(r["edge_id"], r["dst"]) for r in e] == [("e0", "b")] and e[0]["influence"] == pytest.approx(sig(0.5) ** 2)
    totals = {r["id"]: r for r in scoring.explanation_totals(c, s).collect()}
    assert totals["a"]["incoming"] == 0 and totals["b"]["total_influence"] == pytest.approx(sig(0.5) ** 2)
    assert [r["critical_warrants"] for r in scoring.warrant_fragility(c, s).collect()] == [["w1"]]


def test_reasoner(spark):
    r = Reasoner(base(spark))
    out = r.run(["Credibility", "claim_scores", "gate_scores"], explain=True)
    assert set(out) == {"Credibility", "claim_scores", "gate_scores", "explanations"}
    assert r.run([], explain=True) == {"explanations": {}}
    with pytest.raises(ValueError, match="unknown task"):
        r.run(["dance"])


def test_empty(spark):
    s = score_corpus(corpus(spark))
    assert s.claims.collect() == [] and s.warrants.collect() == [] and s.gates.collect() == []


def test_queries_follow_paths_to_their_end(spark, monkeypatch):
    from claimloom.plans import graph_queries as q

    # a chain of six claims; its last one attacks the warrant of an edge between two others
    chain = [(f"c{n}", f"c{n + 1}", "support", ["w1"]) for n in range(1, 6)] + [("x", "y", "support", ["w2", "w1"], "AND")]
    c = corpus(spark, units=units(*(f"c{n}" for n in range(1, 7)), "x", "y"), warrants=warrants("w1", "w2"), relations=edges(*chain), warrant_attacks=[{"attack_idx": 0, "src": "c6", "warrant_id": "w2"}])
    monkeypatch.setattr(q, "load_corpus", lambda spark, d: c)
    got = lambda name: [r.asDict() for r in q.QUERIES[name](spark, "").collect()]
    score = [0.5]
    for _ in range(5):
        score.append(sig(0.5 * score[-1]))
    w2 = sig(-score[-1])
    near = lambda v: pytest.approx(v, abs=2e-6)
    assert {r["id"]: r["score"] for r in got("claim_scores_after_gating")} == {**{f"c{n + 1}": near(v) for n, v in enumerate(score)}, "x": near(0.5), "y": near(sig(0.5 * w2))}
    assert {r["id"]: r["score"] for r in got("warrant_scores")} == {"w1": near(0.5), "w2": near(w2)}
    assert {r["edge_idx"]: r["gate"] for r in got("gate_scores")} == {**dict.fromkeys(range(5), near(0.5)), 5: near(w2)}
    assert {r["edge_id"]: r["influence"] for r in got("score_explanations")}["e5"] == near(0.5 * w2)
    assert {r["id"]: r["final_score"] for r in got("explanation_totals")}["c6"] == near(score[-1])
    assert {r["edge_id"]: (r["gate_score"], r["critical_warrants"]) for r in got("warrant_fragility")}["e5"] == (near(w2), "w2")
