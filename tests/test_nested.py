import json

from claimloom.operators import nested


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def links_of(data: dict, pid: str) -> set:
    """Brute force over the decoded payload."""
    out = set()
    for uid, u in (data.get("units") or {}).items():
        if u is None:
            continue
        out.add((pid, "graph_unit", "", uid))
        for i, e in enumerate(u.get("evidence") or []):
            if e is None:
                continue
            if e.get("id") is not None:
                out.add((pid, "unit_evidence", uid, f"{i}:{e['id']}"))
            s = e.get("source")
            if isinstance(s, dict):
                v = s["value"] if isinstance(s.get("value"), dict) else s
                name = v.get("doc_id") or v.get("evidence_card_id") or (v.get("dataset") or {}).get("name")
                if name:
                    out.add((pid, "evidence_source", f"{uid}#{i}", name))
    for bid, b in (data.get("argument_bundles") or {}).items():
        if b is not None:
            out.add((pid, "graph_bundle", "", bid))
            for i, r in enumerate(b.get("relations") or []):
                if r is not None:
                    out.add((pid, "bundle_relation", bid, f"{i}:{r.get('src') or ''}>{r.get('dst') or ''}"))
    return out


GRAPHS = {
    "p1": {"units": {"c1": {"id": "c1", "evidence": [None, {"id": "e1", "source": {"type": "text_span", "value": {"doc_id": "d1"}}}, {"id": "e2", "source": None}, {"id": "e3"}]}, "c2": {"evidence": []}, "c3": {"evidence": None}, "c4": {}}},
    "p2": {"units": {"c1": {"evidence": [{"id": "e1", "source": {"evidence_card_id": "k1", "note": "n"}}, {"id": "e2", "source": {"type": "structured", "value": {"dataset": {"name": "s", "rows": [1, 2]}}}}]}, "c9": None},
           "argument_bundles": {"a1": {"relations": [{"src": "c1", "dst": "c2"}, None, {"src": "c2", "dst": "c1"}]}, "a2": {"relations": None}, "a3": {}, "a4": {"relations": []}}},
    "p3": {}, "p4": {"units": {}, "argument_bundles": None}, "p5": {"units": [1, 2], "argument_bundles": "x"}, "p6": {"units": {"c1": {"evidence": [{"id": 5, "source": {"doc_id": "x" * 200_000}}]}}},
}


def payloads(spark, extra=()):
    data = [(k, json.dumps(g), 1) for k, g in GRAPHS.items()] + [("q1", None, 1), ("q2", "", 1), ("q3", '{"units": {"c1": {', 1), ("q4", "[]", 1), ("q5", "null", 1), ("q6", '{"units": {"c1": {}}} x', 1), ("q7", '{"units": NaN}', 1), *extra]
    return spark.createDataFrame(data, "payload_id string, payload string, keys int")


def test_links_match_brute_force(spark):
    twice = payloads(spark, [("p1", json.dumps(dict(reversed(GRAPHS["p1"].items()))), 2)])
    got = [tuple(r) for r in nested.payload_links(twice.unionByName(twice)).collect()]
    want = set().union(*(links_of(g, k) for k, g in GRAPHS.items() if k != "p5"))
    want.discard(("p6", "unit_evidence", "c1", "0:5"))
    assert set(got) == {*want, ("p6", "unit_evidence", "c1", "0:5")} and len(got) == len(set(got))


def test_levels_of_one_record():
    tree = nested._tree(["a{}#key", "a{}.b[].c", "a{}.b[]"])
    out = nested.shred_record({"a": {"x": {"b": [{"c": 1}, None, {"c": None}]}, "y": {"b": []}, "z": {}}}, tree)
    r, d, v = out["a{}.b[].c"]
    assert r == [0, 2, 2, 1, 1]
    assert d == [7, 5, 6, 4, 3]
    assert v == ["1", None, None, None, None]
    assert out["a{}#key"][2] == ["x", "y", "z"]


def test_round_trip_of_ordinals():
    record = {"a": {"x": {"b": [{"c": "p"}, {"c": "q"}]}, "y": {"b": [{"c": "r"}]}}}
    tree = nested._tree(["a{}#key", "a{}.b[].c"])
    columns = {p: {"r": r, "d": d, "v": v} for p, (r, d, v) in nested.shred_record(record, tree).items()}
    got = [(o, k[0], f["a{}.b[].c"]) for o, k, f, there in nested.assemble_rows(columns, "a{}.b[]") if there]
    assert got == [((0, 0), "x", "p"), ((0, 1), "x", "q"), ((1, 0), "y", "r")]


def test_empty_table(spark):
    assert nested.payload_links(payloads(spark).where("false")).collect() == []


def test_flat_tables_keep_every_field(spark):
    span = {"doc_id": "d1", "start": 1, "end": 5, "text": "t", "page": 2, "bbox": [0.5, 1.0], "modality": "image"}
    g = {"units": {"c.1": {"text": "a", "score": 0.5, "odd": [1], "metadata": {"b": 1, "a": 2}, "spans": [None, span], "evidence_ids": ["e1", None, "e2"],
                           "evidence": [{"id": "x", "strength": 1, "quality": {"m": "q"}, "source": {"type": "text_span", "value": span}}, {"id": "y", "source": {"evidence_card_id": "k", "note": "n"}}]}},
         "warrants": {"w1": {"text": "w"}}, "relations": [{"src": "c1", "dst": "c2", "weight": 0.1, "warrant_ids": ["w1"]}, "no relation"],
         "argument_bundles": {"b": {"units": ["c.1"], "relations": [{"src": "c1", "why": "z"}]}}, "metadata": {"title": "T"}}
    df = spark.createDataFrame([("p", json.dumps(g)), ("p", json.dumps(dict(reversed(g.items())))), ("q", "{}")], "payload_id string, payload string")
    table = lambda n: sorted(nested.payload_table(df, n).drop("payload_id").collect(), key=str)
    (u,) = table("units")
    assert (u["key"], u["text"], u["score"], u["metadata"], u["rest"]) == ("c.1", "a", 0.5, '{"a": 2, "b": 1}', '{"odd": [1]}')
    e = {r["pos"]: r for r in table("evidence")}
    assert (e[0]["key"], e[0]["strength"], e[0]["quality"], e[0]["source_type"], e[0]["source_page"], e[0]["source_bbox"]) == ("c.1", 1.0, '{"m": "q"}', "text_span", 2, "[0.5, 1.0]")
    assert (e[1]["source_evidence_card_id"], e[1]["source_note"], e[1]["source_doc_id"]) == ("k", "n", None)
    assert [(r["pos"], r["page"], r["modality"]) for r in table("spans")] == [(1, 2, "image")]
    assert {(r["place"], r["key"], r["pos"], r["src"], r["rest"]) for r in table("relations")} == {("relations[]", None, 0, "c1", None), ("relations[]", None, 1, None, '"no relation"'), ("argument_bundles{}.relations[]", "b", 0, "c1", '{"why": "z"}')}
    assert {(r["place"], r["key"], r["parent_pos"], r["pos"], r["value"]) for r in table("lists")} == {("units{}.evidence_ids[]", "c.1", None, 0, "e1"), ("units{}.evidence_ids[]", "c.1", None, 2, "e2"), ("relations[].warrant_ids[]", None, 0, 0, "w1"), ("argument_bundles{}.units[]", "b", None, 0, "c.1")}
    assert rows(nested.payload_rest(df)) == [("p", '{"metadata": {"title": "T"}}'), ("q", None)]


def test_array_columns(spark):
    schema = "unit_id string, graph_id string, evidence array<struct<id: string, source: struct<kind: string, span: struct<doc_id: string, start: int, page: int>, structured: string>, stance: string, strength: double, quality: string>>, spans array<struct<doc_id: string, start: int>>, evidence_ids array<string>, loaded_at int"
    ev = lambda i: (i, ("text_span", ("d1", 3, 7), None), "supports", 0.5, '{"q": 1}')
    df = spark.createDataFrame([("c1", "g", [None, ev("old")], [], ["e9"], 1), ("c1", "g", [None, ev("x")], [("d2", 4)], ["e1", None], 2), ("c2", "g", None, None, None, 1)], schema)
    nodes = {"units": (df, "unit_id"), "warrants": (df.limit(0), "unit_id")}
    (e,) = nested.array_table(nodes, "evidence").collect()
    assert (e["table_name"], e["owner_key"], e["pos"], e["id"], e["strength"], e["quality"], e["source_span_page"]) == ("units", "c1", 1, "x", 0.5, '{"q": 1}', 7)
    assert [(r["pos"], r["doc_id"], r["start"]) for r in nested.array_table(nodes, "spans").collect()] == [(0, "d2", 4)]
    assert [(r["pos"], r["value"]) for r in nested.array_table(nodes, "evidence_ids").collect()] == [(0, "e1")]
