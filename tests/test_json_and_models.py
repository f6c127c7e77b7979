import json

import pytest
from helpers import corpus, edges, units, warrants

from claimloom import cli
from claimloom.operators import mining
from claimloom.operators import model_hooks as mh
from claimloom.operators import validate
from claimloom.operators.corpus import Rejected, add_claims, add_relations, add_unique, add_warrant_attacks, add_warrants, attach_cards, attach_evidence, new_graphs
from claimloom.sources import graph_json
from claimloom.sources.graph_json import decode_graphs, encode_graphs

GRAPH = {
    "units": {"c1": {"id": "c1", "text": "A", "type": "fact", "spans": [{"doc_id": "d", "start": 0, "end": 1, "text": "A", "page": 3, "modality": "pdf"}],
                     "evidence": [{"id": "e1", "source": {"type": "text_span", "value": {"doc_id": "doc1", "start": 1, "end": 2, "text": "t"}}, "stance": "supports", "strength": 0.9},
                                  {"id": "e2", "source": {"evidence_card_id": "k1"}, "stance": "attacks"}], "evidence_ids": ["k1"]},
              "c2": {"id": "c2", "text": "B", "is_axiom": True, "score": 0.5}},
    "relations": [{"src": "c1", "dst": "c2", "kind": "support", "weight": 0.7, "warrant_ids": ["w1"], "metadata": {"gate_disabled": True, "note": "n"}}],
    "metadata": {}, "warrants": {"w1": {"id": "w1", "text": "W"}}, "warrant_attacks": [{"src": "c1", "warrant_id": "w1"}],
    "evidence_cards": {"k1": {"id": "k1", "title": "T", "supporting_doc_id": "doc1", "excerpt": "x", "confidence": 0.8}},
    "supporting_documents": {"doc1": {"id": "doc1", "name": "n", "type": "pdf", "url": "u"}},
    "argument_bundles": {"a1": {"id": "a1", "units": ["c1", "c2"]}},
}


def decoded(spark, *texts):
    return graph_json.decode_graphs(spark.createDataFrame([(f"g{i}", t) for i, t in enumerate(texts)], "k string, payload string"), "k", "payload")


def test_round_trip(spark):
    c = decoded(spark, json.dumps(GRAPH), None, "{cut", "[]")
    assert {r["graph_id"] for r in c.units.collect()} == {"g0"}
    u = {r["unit_id"]: r for r in c.units.collect()}
    assert u["c1"]["evidence"][0]["source"]["span"]["doc_id"] == "doc1" and json.loads(u["c1"]["evidence"][1]["source"]["structured"]) == {"evidence_card_id": "k1"}
    assert u["c2"]["is_axiom"] and u["c2"]["type"] == "other" and c.relations.collect()[0]["gate_disabled"] is True
    text = graph_json.encode_graphs(c).collect()[0]["payload"]
    again = json.loads(text)
    assert list(again) == sorted(again) and validate.graph_errors(again) == []
    assert again["relations"][0]["metadata"] == {"note": "n", "gate_disabled": True}
    assert again["units"]["c1"]["evidence"][0]["source"]["type"] == "text_span" and again["units"]["c1"]["evidence"][1]["source"] == {"type": "structured", "value": {"evidence_card_id": "k1"}}
    d = decoded(spark, text)
    for name in ("units", "warrants", "relations", "warrant_attacks", "evidence_cards", "supporting_documents"):
        x, y = (sorted(map(str, getattr(z, name).drop("metadata").collect())) for z in (c, d))
        assert x == y, name


def test_files(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(GRAPH))
    c = graph_json.read_graphs(spark, str(tmp_path))
    assert {r["graph_id"] for r in c.units.collect()} == {"one"}
    graph_json.write_graphs(c, str(tmp_path / "out"))
    assert len(spark.read.text(str(tmp_path / "out")).collect()) == 1
    (tmp_path / "bad.json").write_text(json.dumps(GRAPH | {"relations": [{"src": "c9", "dst": "c1", "kind": "support"}]}))
    with pytest.raises(ValueError, match="not a known unit id"):
        graph_json.read_graphs(spark, str(tmp_path), validate=True)


VIOLATIONS = [
    ([], ["Graph payload must be a dictionary."]),
    ({}, ["units must be a dictionary of id -> unit.", "relations must be a list."]),
    ({"units": {}, "relations": [], "metadata": [], "warrants": None, "warrant_attacks": None}, ["metadata must be an object when provided.", "warrants must be an object when provided."]),
    ({"units": {"c1": 1, "c2": {"id": "x", "spans": {}, "evidence_min": "1", "score": True, "is_axiom": 1, "metadata": None}}, "relations": []},
     ["unit 'c1' must be an object.", "unit 'c2' must include 'id' and 'text'.", "unit 'c2' id field does not match its key.", "unit 'c2' spans must be a list.", "unit 'c2' evidence_min must be a number.", "unit 'c2' is_axiom must be a boolean.", "unit 'c2' metadata must be an object."]),
    (GRAPH | {"relations": [{"src": "c9", "dst": "c1"}, 1, {"src": "c1", "dst": "c2", "kind": "x", "warrant_ids": ["w9"], "gate_mode": "XOR"}]},
     ["relation[0] missing 'kind'.", "relation[0] src 'c9' is not a known unit id.", "relation[1] must be an object.", "relation[2] warrant_id 'w9' is not a known warrant.", "relation[2] gate_mode must be AND or OR."]),
    (GRAPH | {"warrant_attacks": [1, {}, {"src": "zz", "warrant_id": "yy"}]},
     ["warrant_attacks[0] must be an object.", "warrant_attacks[1] missing 'src' or 'warrant_id'.", "warrant_attacks[2] src 'zz' is not a known unit id.", "warrant_attacks[2] warrant_id 'yy' is not a known warrant."]),
    (GRAPH | {"evidence_cards": {"k2": {"id": "k2", "title": "t", "supporting_doc_id": "nope"}}}, ["unit 'c1' evidence_id 'k1' is not a known evidence card.", "evidence_card 'k2' references unknown supporting_doc_id."]),
    (GRAPH | {"argument_bundles": {"a": {"id": "b", "units": ["c7"]}}, "supporting_documents": {"doc1": {"id": "doc1", "name": "n", "trust": "x"}}},
     ["supporting_document 'doc1' trust must be a number.", "argument_bundle 'a' id field does not match its key.", "argument_bundle 'a' references unknown unit 'c7'."]),
    (GRAPH, []),
]


@pytest.mark.parametrize(("data", "want"), VIOLATIONS)
def test_rules(data, want):
    assert validate.graph_errors(data) == want


def test_violations_as_rows(spark):
    df = spark.createDataFrame([("a", json.dumps(GRAPH)), ("b", "{}"), ("c", None), ("d", "{")], "k string, payload string")
    got = [(r["k"], r["error_ord"]) for r in validate.payload_violations(df, "k", "payload").collect()]
    assert sorted(got) == [("b", 0), ("b", 1), ("c", 0), ("d", 0)]
    with pytest.raises(ValueError, match="Invalid graph payload:\n- units"):
        validate.require_valid({})


def test_cli(tmp_path, capsys, spark):
    path = tmp_path / "g.json"
    path.write_text(json.dumps(GRAPH))
    assert cli.main(["validate", str(path)]) == 0 and capsys.readouterr().out == "OK\n"
    assert cli.main(["version"]) == 0
    capsys.readouterr()
    assert cli.main(["dot", str(path), "--validate"]) == 0 and '"c1" -> "c2"' in capsys.readouterr().out
    assert cli.main(["diagnostics", str(path)]) == 0
    d = json.loads(capsys.readouterr().out)
    assert d["node_count"] == 2 and d["reachability"] == {"c1": ["c2"], "c2": []} and d["axioms"]["claims"] == ["c2"]


def test_building(spark):
    c = corpus(spark, units=units("c1", "c7"), warrants=warrants("w3"))
    new = spark.createDataFrame([("g", None, 0, "new"), ("g", "c1", 1, "changed"), ("g", None, 2, "newer"), ("h", None, 0, "other")], "graph_id string, unit_id string, ord int, text string")
    c = add_claims(c, new)
    assert {(r["graph_id"], r["unit_id"], r["ord"], r["text"]) for r in c.units.collect()} == {("g", "c1", 0, "changed"), ("g", "c7", 1, "text c7"), ("g", "c8", 2, "new"), ("g", "c9", 3, "newer"), ("h", "c1", 0, "other")}
    c = add_warrants(c, spark.createDataFrame([("g", None, 0, "w")], "graph_id string, warrant_id string, ord int, text string"))
    assert {r["warrant_id"] for r in c.warrants.collect()} == {"w3", "w4"}
    rel = spark.createDataFrame([("g", 0, "c1", "c7", "support"), ("g", 1, "c7", "zz", "attack")], "graph_id string, ord int, src string, dst string, kind string")
    c = add_relations(add_relations(c, rel), rel)
    assert sorted((r["edge_idx"], r["src"], r["gate_mode"]) for r in c.relations.collect()) == [(0, "c1", "OR"), (1, "c7", "OR"), (2, "c1", "OR"), (3, "c7", "OR")]
    attack = spark.createDataFrame([("g", 0, "zz", "w4")], "graph_id string, ord int, src string, warrant_id string")
    assert add_warrant_attacks(c, attack).warrant_attacks.collect()[0]["kind"] == "attack"
    with pytest.raises(Rejected, match="unknown warrant"):
        add_warrant_attacks(c, spark.createDataFrame([("g", 0, "c1", "w9")], attack.schema))
    card = corpus(spark, evidence_cards=[{"card_id": "k", "ord": 0, "title": "t", "supporting_doc_id": "d", "excerpt": "x", "confidence": 0.4}]).evidence_cards
    c = add_unique(c, card, "evidence_cards")
    with pytest.raises(Rejected, match="exists already"):
        add_unique(c, card, "evidence_cards")
    assert add_unique(c, card, "evidence_cards", overwrite=True).evidence_cards.count() == 1
    at = spark.createDataFrame([("g", "c1", "k", 0, "e1", None), ("g", "c1", "k", 1, "e2", "attacks")], "graph_id string, unit_id string, card_id string, ord int, evidence_id string, stance string")
    u = {r["unit_id"]: r for r in attach_cards(c, at).units.where("graph_id = 'g'").collect()}
    assert [(e["id"], e["stance"], e["strength"]) for e in u["c1"]["evidence"]] == [("e1", "supports", 0.4), ("e2", "attacks", 0.4)] and u["c1"]["evidence_ids"] == ["k"] and u["c7"]["evidence"] is None
    with pytest.raises(Rejected, match="unknown target"):
        attach_evidence(c, spark.createDataFrame([("g", "nope", 0)], "graph_id string, unit_id string, ord int"))


def test_answers():
    assert mh.tolerant_json('x ```json\n{"a": 1}\n``` y') == {"a": 1} and mh.tolerant_json('say {"a": 2} ok') == {"a": 2} and mh.tolerant_json("no") == {} and mh.tolerant_json(None) == {}
    assert mh.parse_claim_type('{"claim_type": "Factual", "confidence": 3}') == {"claim_type": "fact", "confidence": 1.0, "rationale": None}
    assert mh.parse_edge('{"evaluation": "attacks", "score": -4, "rationale": " r "}') == {"evaluation": "attack", "score": -1.0, "rationale": "r"}
    assert mh.parse_assumptions('[{"assumption": "a"}, {"assumption": ""}, {"assumption": "b", "importance": 2}, {"assumption": "c"}]', 2) == [{"assumption": "a", "rationale": None, "importance": None}, {"assumption": "b", "rationale": None, "importance": 1.0}]
    assert mh.parse_relations('{"relations": [{"src": "c1", "dst": "c1", "kind": "support"}, {"src": "c1", "dst": "c2", "kind": "Rebut"}, {"src": "c1", "dst": "c2", "kind": "x"}]}') == [{"src": "c1", "dst": "c2", "kind": "rebut", "rationale": None}]
    assert mining.parse_segments('[{"text": "ab"}, {"id": "s", "text": "c", "start": 5}, 1]') == [{"seg_id": "seg-1", "text": "ab", "start": 0, "end": 2, "metadata": "{}"}, {"seg_id": "s", "text": "c", "start": 5, "end": 1, "metadata": "{}"}]
    assert mh._dig('{"choices": [{"message": {"content": "hi"}}]}', "choices", 0, "message", "content") == "hi" and mh._dig("raw", "x") == "raw" and mh._dig("{}", "x") == ""
    assert mining.parse_segments('[{"text": "a", "metadata": {"k": 1}}]')[0]["metadata"] == '{"k": 1}' and mining.parse_segments("nope") == []
    graph = json.dumps({"units": {"c1": {"id": "c1", "text": "t", "spans": [{"doc_id": "x", "start": 0, "end": 1, "text": "t"}]}}, "relations": []})
    assert mining.parse_graph(graph, "d9")[0]["units"]["c1"]["spans"][0]["doc_id"] == "d9" and mining.parse_graph(graph)[0]["units"]["c1"]["spans"][0]["doc_id"] == "x"


def test_requests_of_the_services():
    url, headers, body = mh.HttpClient("anthropic", "m", api_key="k", options={"top_k": 1}).request("p", {"user": "u"})
    assert url.endswith("/messages") and headers["x-api-key"] == "k" and body == {"model": "m", "messages": [{"role": "user", "content": "p"}], "max_tokens": 1024, "top_k": 1, "metadata": {"user": "u"}}
    url, headers, body = mh.HttpClient("openai", "m", api_key="k").request("p")
    assert url.endswith("/chat/completions") and headers == {"Authorization": "Bearer k"} and "max_tokens" not in body
    assert mh.HttpClient("ollama", "m", options={"seed": 1}).request("p")[2] == {"model": "m", "prompt": "p", "stream": False, "options": {"seed": 1}}
    with pytest.raises(RuntimeError, match="request to openai failed"):
        mh.HttpClient("openai", "m", api_key="k", base_url="http://127.0.0.1:9", timeout=0.2).complete("p")


def test_coroutine_client(spark):
    class Later:
        async def complete(self, prompt, *, metadata=None):
            return prompt.upper()

    df = spark.createDataFrame([("a",), (None,), ("b",)], "p string")
    assert [r["response"] for r in mh.ask(df, "p", Later).collect()] == ["A", None, "B"]


def credibility(spark, answer, **more):
    u = units("a", "b")
    u[0]["evidence_ids"] = ["k1", "k2"]
    cards = [{"card_id": k, "ord": i, "excerpt": k, "confidence": c} for i, (k, c) in enumerate((("k1", 1.0), ("k2", 0.2)))]
    c = corpus(spark, **{"units": u, "evidence_cards": cards} | more)
    return {r["unit_id"]: (round(r["claim_score"], 6), round(r["weighted_score"], 6), r["score_source"]) for r in mh.score_claims(c, mh.OfflineClient(json.dumps(answer))).collect()}


def test_credibility(spark):
    scores = [{"evidence_id": "k1", "score": 1}, {"evidence_id": "k2", "score": -1}]
    assert credibility(spark, {"evidence": scores}) == {"a": (0.666667, 0.666667, "weighted"), "b": (0.0, 0.0, "none")}
    assert credibility(spark, {"claim_score": -0.4, "evidence": scores})["a"] == (-0.4, 0.666667, "llm")
    assert credibility(spark, {"claim_score": 0.9, "evidence": [{"evidence_id": "k1", "score": 1, "rationale": "Only INDIRECT"}]})["a"] == (0.0, 0.0, "weighted_consistency")
    assert credibility(spark, {"claim_score": "x", "evidence": []})["a"] == (0.0, 0.0, "weighted")


def test_credibility_of_some_claims_and_what_is_kept(spark):
    u = units("a", "b", metadata='{"m": 1}')
    u[0]["evidence_ids"] = ["k1"]
    c = corpus(spark, units=u, evidence_cards=[{"card_id": "k1", "ord": 0, "excerpt": "x", "confidence": 0.5}])
    only = lambda i: spark.createDataFrame([("g", i)], "graph_id string, unit_id string")
    s = mh.score_claims(c, mh.OfflineClient('{"evidence": [{"evidence_id": "k1", "score": 1, "rationale": "r"}]}'), only=only("a"))
    assert [(r["unit_id"], r["claim_score"]) for r in s.collect()] == [("a", 1.0)]
    kept = {r["unit_id"]: json.loads(r["metadata"]) for r in mh.persist_scores(c.units, s).collect()}
    assert kept == {"a": {"m": 1, "claim_credibility": 1.0, "claim_credibility_weighted": 1.0, "claim_credibility_method": "weighted", "claim_credibility_evidence": [{"evidence_id": "k1", "trust": 0.5, "score": 1.0, "rationale": "r"}]}, "b": {"m": 1}}
    with pytest.raises(Rejected, match="unknown claim"):
        mh.score_claims(c, mh.OfflineClient("{}"), only=only("zz"))


def test_edges_and_assumptions(spark):
    c = corpus(spark, units=units("a", "b"), relations=edges(("a", "b", "support", []), ("a", "zz", "attack", [])))
    assert [(r["edge_idx"], r["evaluation"]) for r in mh.judge_edges(c, mh.OfflineClient('{"evaluation": "support", "score": 0.5}')).collect()] == [(0, "support")]
    assert mh.missing_assumptions(c).collect() == []
    got = mh.missing_assumptions(c, mh.OfflineClient('{"assumptions": [{"assumption": "x"}]}')).collect()
    assert [(r["edge_idx"], r["assumptions"][0]["assumption"]) for r in got] == [(0, "x")]


def test_pipeline(spark):
    df = spark.createDataFrame([("d1", "First.\n\nSecond."), ("d2", "Nothing here.")], "doc_id string, text string")
    client = mh.OfflineClient("none", {"Text:\nFirst": '{"claims": [{"text": "First", "type": "FACT"}]}', "Text:\nSecond": '{"claims": [{"text": "second"}, {"text": "FIRST"}]}', "Claims:": '{"relations": [{"src": "c1", "dst": "c2", "kind": "support"}, {"src": "c1", "dst": "c9", "kind": "support"}]}'})
    u, r, d = mining.pipeline_of(client).run(df, "doc_id", "text")
    told = {x["doc_id"]: json.loads(x["metadata"])["mining"] for x in d.collect()}
    assert told["d1"] == {"trace": ["segments: 2", "seg-1: claims 1", "seg-2: claims 2", "claims: 2 (merged 1)", "relations: 1"], "segments": ["seg-1", "seg-2"], "merge_summary": {"merged": 1, "mapping": {"c1": "c2", "c2": "c1"}}}
    assert told["d2"] == {"trace": ["segments: 1", "seg-1: claim parse failed", "no claims from llm; fallback miner"], "llm_fallback": True}
    assert sorted((x["doc_id"], x["unit_id"], x["text"], x["type"], x["start"], x["llm_fallback"]) for x in u.collect()) == [("d1", "c1", "First", "fact", 0, False), ("d1", "c2", "second", "other", 8, False), ("d2", "c1", "Nothing here.", "other", 0, True)]
    assert [tuple(x) for x in r.select("doc_id", "src", "dst", "kind").collect()] == [("d1", "c1", "c2", "support")]
    hooked = {x["doc_id"]: x for x in mining.hooked_miner(df, "doc_id", "text", mh.OfflineClient("```json\n" + json.dumps(GRAPH) + "\n```")).collect()}
    named = json.loads(json.dumps(GRAPH).replace('"doc_id": "d"', '"doc_id": "d1"'))  # spans of units get the document's id
    assert not hooked["d1"]["fallback"] and json.loads(hooked["d1"]["graph"]) == named
    bad = mining.hooked_miner(df, "doc_id", "text", mh.OfflineClient("x" * 900)).collect()
    assert all(x["fallback"] and len(x["response"]) == 500 and x["errors"] for x in bad)


def test_long_documents(spark):
    df = spark.createDataFrame([("d", "Cats purr. Dogs bark.\n\nDOGS BARK. Fish swim.")], "doc_id string, text string")
    got = {r["new_id"]: (r["text"], len(r["source_unit_ids"]), r["segments"], [tuple(s) for s in r["spans"]]) for r in mining.mine_long(df, "doc_id", "text").collect()}
    assert got == {"c1": ("Cats purr.", 1, 1, [(0, 10)]), "c2": ("Dogs bark.", 2, 2, [(10, 21), (23, 33)]), "c3": ("Fish swim.", 1, 1, [(33, 44)])}


def test_splitters_and_miners_by_a_model(spark):
    import asyncio

    df = spark.createDataFrame([("d", "Alpha Beta. Gamma."), ("e", "Delta.\n\nEta.")], "doc_id string, text string")
    cutter = mining.model_splitter(mh.OfflineClient("none", {"Alpha": '[{"id": "s1", "text": "Alpha Beta.", "start": 0, "end": 11}, {"text": "Gamma.", "start": 12}]'}))
    assert sorted((r["doc_id"], r["seg_id"], r["start"], r["end"]) for r in cutter(df, "doc_id", "text").collect()) == [("d", "s1", 0, 11), ("d", "seg-2", 12, 6), ("e", "seg-1", 0, 6), ("e", "seg-2", 8, 12)]
    got = asyncio.run(mining.mine_long_async(df, "doc_id", "text", splitter=cutter))
    assert sorted((r["doc_id"], r["text"], tuple(r["spans"][0])) for r in got.collect()) == [("d", "Alpha Beta.", (0, 11)), ("d", "Gamma.", (12, 18)), ("e", "Delta.", (0, 6)), ("e", "Eta.", (8, 12))]
    one = json.dumps({"units": {"c1": {"id": "c1", "text": "A", "type": "fact"}}, "relations": []})
    mined = mining.miner_of(mh.OfflineClient("bad", {"Alpha": one}))(df, "doc_id", "text")
    assert sorted((r["doc_id"], r["unit_id"], r["text"], r["type"]) for r in mined.collect()) == [("d", "c1", "A", "fact"), ("e", "c1", "Delta.", "other"), ("e", "c2", "Eta.", "other")]


def test_graph_and_bundle_data_survive(spark):
    graph = {"units": {}, "relations": [], "metadata": {"title": "t", "n": [1]}, "argument_bundles": {"b1": {"id": "b1", "units": [], "relations": [{"src": "a", "dst": "b", "kind": "support", "weight": 0.5}], "metadata": {}}}}
    df = spark.createDataFrame([("g", json.dumps(graph))], "k string, payload string")
    back = json.loads(encode_graphs(decode_graphs(df, "k", "payload")).collect()[0]["payload"])
    assert back["metadata"] == graph["metadata"] and back["argument_bundles"] == graph["argument_bundles"]
    c = new_graphs(corpus(spark), spark.createDataFrame([("g", "T", None), ("h", "", '{"a": 1}'), ("i", "U", '{"a": 1}')], "graph_id string, title string, metadata string"))
    assert {r["graph_id"]: json.loads(r["metadata"]) for r in c.graphs.collect()} == {"g": {"title": "T"}, "h": {"a": 1}, "i": {"a": 1, "title": "U"}}
    assert {r["graph_id"] for r in encode_graphs(c).collect()} == {"g", "h", "i"}


def test_reconcile_contract(spark):
    from claimloom.operators.reconcile import reconcile

    seg = spark.createDataFrame([("d", "s1", 0, 0, 5), ("d", "s2", 1, 5, 9)], "doc_id string, segment_id string, seg_ord int, start int, end int")
    unit = spark.createDataFrame([("d", "s1", 0, "c1", 0, "A", "other", None, None, None), ("d", "s2", 1, "c1", 0, "a", "other", None, None, None)], "doc_id string, segment_id string, seg_ord int, unit_id string, ord int, text string, type string, evidence_ids array<string>, evidence_min double, evidence_max double")
    rel = spark.createDataFrame([], "doc_id string, segment_id string, seg_ord int, edge_idx int, src string, dst string, kind string, weight double, rationale string")
    out = reconcile(seg, seg.select("doc_id", "segment_id"), unit, rel)
    assert json.loads(out.documents.collect()[0]["metadata"]) == {"segments": [{"id": "s1", "start": 0, "end": 5}, {"id": "s2", "start": 5, "end": 9}]}
    assert out.units.count() == 1 and out.unit_segments.count() == 2
    with pytest.raises(Rejected, match="do not match"):
        reconcile(seg, seg.where("seg_ord = 0").select("doc_id", "segment_id"), unit, rel)


def test_critique(spark):
    from claimloom.operators.critique import critique

    c = corpus(spark, units=units("a", "b"), warrants=warrants("w"), relations=edges(("a", "b", "support", ["w"]), ("a", "a", "attack", [])))
    got = critique(c)
    assert got.missing_assumptions.collect() == [] and {r["pattern_id"] for r in got.patterns.collect()} == {"self_attack", "unstated_warrant", "unsupported_conclusion"}
    assert [r["critical_warrants"] for r in got.warrant_fragility.collect()] == [["w"]]


def test_streamed_ingest(spark, tmp_path):
    from claimloom.streaming.ingest import ingest_payloads, payload_stream

    spark.createDataFrame([("g1", json.dumps(GRAPH))], "payload_id string, payload string").write.parquet(str(tmp_path / "in"))
    q = ingest_payloads(payload_stream(spark, str(tmp_path / "in"), "payload_id string, payload string"), "payload_id", "payload", str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out" / "units")).count() == 2
