import datetime as dt

from claimloom.operators.orphans import orphan_references, orphan_report

DAY = dt.datetime(2024, 1, 1)
REL = "graph_id string, edge_idx int, src string, dst string, loaded_at timestamp_ntz, target string"
PAR = "graph_id string, {} string, loaded_at timestamp_ntz, deleted_at timestamp_ntz, ref_key int"


def at(n):
    return DAY + dt.timedelta(days=n)


def tables(spark, relations, units, cards=(), docs=(), attacks=(), warrants=()):
    make = spark.createDataFrame
    return {
        "relations": make(relations, REL), "units": make(units, PAR.format("unit_id")),
        "evidence_cards": make(list(cards), "graph_id string, card_id string, supporting_doc_id string, loaded_at timestamp_ntz"),
        "supporting_documents": make(list(docs), PAR.format("doc_id")),
        "warrant_attacks": make(list(attacks), "graph_id string, attack_idx int, warrant_id string, loaded_at timestamp_ntz"),
        "warrants": make(list(warrants), PAR.format("warrant_id")),
    }


def test_reasons(spark):
    relations = [
        ("g", 0, "c1", "c2", at(5), "x"), ("g", 0, "c1", "c2", at(9), "x"),  # c2 is deleted; delivered twice
        ("g", 1, "c3", "c4", at(5), "x"),  # c3 late, c4 missing
        ("g", 2, None, "", at(5), "x"), ("h", 3, "c1", "c5", at(5), "x"),  # other graph: missing; c5 re-created
        ("g", 4, "c3", "c1", at(40), "x"), (None, 5, "c1", "c1", at(5), "x"),
    ]
    units = [("g", "c1", at(1), None, 1), ("g", "c1", at(8), None, 1), ("g", "c2", at(1), at(2), 1), ("g", "c3", at(7), None, 1), ("h", "c5", at(1), at(2), 1), ("h", "c5", at(6), None, 1)]
    cards = [("g", "k1", "d1", at(1)), ("g", "k2", None, at(1)), ("g", "k3", "d9", at(1))]
    docs = [("g", "d1", at(1), None, 1)]
    attacks = [("g", 0, "w1", at(3)), ("g", 1, "w2", at(3))]
    warrants = [("g", "w1", at(1), at(2), 1), ("g", "w1", at(2), at(3), 1)]
    df = orphan_references(tables(spark, relations, units, cards, docs, attacks, warrants))
    got = sorted((r["table_name"], r["field_name"], r["period"], r["graph_id"] or "", r["record_key"], r["ref_key"], r["reason"]) for r in df.collect())
    assert got == sorted([
        ("relations", "dst", "2024-01", "g", "0", "c2", "deleted"), ("relations", "src", "2024-01", "g", "1", "c3", "late"), ("relations", "dst", "2024-01", "g", "1", "c4", "missing"),
        ("relations", "src", "2024-01", "h", "3", "c1", "missing"), ("relations", "src", "2024-01", "", "5", "c1", "missing"), ("relations", "dst", "2024-01", "", "5", "c1", "missing"),
        ("evidence_cards", "supporting_doc_id", "2024-01", "g", "k3", "d9", "missing"), ("warrant_attacks", "warrant_id", "2024-01", "g", "0", "w1", "deleted"), ("warrant_attacks", "warrant_id", "2024-01", "g", "1", "w2", "missing"),
    ])
    report = {(r["table_name"], r["field_name"], r["reason"]): r["orphans"] for r in orphan_report(df).collect()}
    assert report["relations", "src", "missing"] == 2 and sum(report.values()) == 9


def test_one_hot_key(spark):
    relations = [("g", i, "gone", "c1", at(1), "x") for i in range(3000)]
    got = orphan_references(tables(spark, relations, [("g", "c1", at(0), None, 1)])).collect()
    assert len(got) == 3000 and {r["reason"] for r in got} == {"missing"}


def test_empty(spark):
    assert orphan_references(tables(spark, [], [])).collect() == []
