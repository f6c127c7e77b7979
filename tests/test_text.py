import random
import re

import pytest
from helpers import corpus, edges, units
from pyspark.sql import functions as F

from claimloom.functions.text import ascii_tokens, token_jaccard, token_overlap, word_tokens
from claimloom.operators.grouped import ordered_rank
from claimloom.operators import evaluation, reconcile, segments


def texts(spark, *values):
    return spark.createDataFrame([(i, t, 0) for i, t in enumerate(values)], "doc_id int, text string, ord int")


def spans(df):
    return [(r["doc_id"], r["text"], r["start"], r["end"]) for r in sorted(df.collect(), key=lambda r: (r["doc_id"], r["start"]))]


def test_sentences(spark):
    got = segments.sentence_claims(texts(spark, "A sentence. Another one.", "A.. B! c", None, "", " . "), "doc_id", "text")
    assert spans(got) == [(0, "A sentence.", 0, 11), (0, "Another one.", 11, 24), (1, "A.", 0, 2), (1, "B!", 3, 6), (1, "c", 6, 8), (4, ".", 0, 2)]


def test_paragraphs(spark):
    got = spans(segments.paragraphs(texts(spark, "Alpha\n\nBeta\n\nGamma", "\nA\n\nB", "A\n", " \n", "A\n \n\n  B\n\n", None), "doc_id", "text"))
    assert got == [(0, "Alpha", 0, 5), (0, "Beta", 7, 11), (0, "Gamma", 13, 18), (1, "B", 4, 5), (2, "A", 0, 1), (4, "A", 0, 1), (4, "  B", 5, 8)]
    assert segments.paragraph_spans("ab\n\ncdef", min_chars=3) == [(0, "seg-1", "cdef", 4, 8)]


def test_windows(spark):
    got = segments.fixed_windows(texts(spark, "abcdefghij", "", None, "    xy", "ab"), "doc_id", "text", 4, 1)
    assert spans(got) == [(0, "abcd", 0, 4), (0, "defg", 3, 7), (0, "ghij", 6, 10), (3, " xy", 3, 6), (4, "ab", 0, 2)]
    with pytest.raises(ValueError, match="overlap"):
        segments.fixed_windows(texts(spark, "a"), "doc_id", "text", 4, 4)


def test_locate(spark):
    start, end = segments.locate(F.col("c"), F.col("s"), F.lit(10))
    df = spark.createDataFrame([("World", "hello WORLD"), ("x", "abc"), ("🙂b", "a🙂B")], "c string, s string")
    assert [(r[0], r[1]) for r in df.select(start, end).collect()] == [(16, 21), (None, None), (11, 13)]


def test_similarity(spark):
    df = spark.createDataFrame([("Cats are good.", "Cats are very good."), ("", "!"), ("a", ""), ("é", "É")], "a string, b string")
    got = df.select(token_jaccard(ascii_tokens(F.col("a")), ascii_tokens(F.col("b"))), token_overlap(word_tokens(F.col("a")), word_tokens(F.col("b")))).collect()
    assert [tuple(r) for r in got] == [(0.75, 0.75), (1.0, 0.0), (0.0, 0.0), (1.0, 1.0)]


def test_evaluation(spark):
    u = units("c1", "c2")
    u[0]["text"] = "Dogs are friendly animals."
    u[0]["evidence"] = [("e1", ("structured", None, '{"text": "Dogs are often friendly with humans."}'), "neutral", None, None), None, ("e2", ("structured", None, '{"evidence_card_id": "k"}'), "supports", None, None)]
    u[1]["text"] = None
    c = corpus(spark, units=u, relations=edges(("c1", "c2", "attack", []), ("c1", "c1", "attack", []), ("c1", "zz", "attack", [])))
    e = {r["evidence_id"]: (r["evaluation"], round(r["confidence"], 6)) for r in evaluation.evaluate_evidence(c.units).collect()}
    assert e == {"e1": ("supports", 0.428571), "e2": ("neutral", 0.0)}
    scored = {r["unit_id"]: r["evidence"] for r in evaluation.score_evidence(c.units).collect()}
    assert round(scored["c1"][0]["strength"], 6) == 0.428571 and scored["c1"][0]["stance"] == "supports" and scored["c1"][1] is None and scored["c2"] is None
    v = {r["edge_idx"]: (r["kind"], r["confidence"]) for r in evaluation.validate_edges(c.units, c.relations).collect()}
    assert v == {0: ("attack", 0.0), 1: ("support", 1.0), 2: ("attack", None)}


def test_python_repr(spark):
    said = ['{"evidence_card_id": "k", "b": "c"}', '{"a": 1, "b": [true, null, {"c": "it\'s", "d": 1.50}]}', None, "no json"]
    df = spark.createDataFrame([(x,) for x in said], "s string")
    assert [r[0] for r in df.select(evaluation.python_repr(F.col("s"))).collect()] == ["{'evidence_card_id': 'k', 'b': 'c'}", str({"a": 1, "b": [True, None, {"c": "it's", "d": 1.5}]}), None, "no json"]


SEG = "doc_id string, segment_id string, seg_ord int, unit_id string, ord int, text string, type string, evidence_ids array<string>, evidence_min double, evidence_max double"


def segment_units(spark, rows):
    return spark.createDataFrame([("d", s, n, u, o, t, "other", ids, lo, hi) for s, n, u, o, t, ids, lo, hi in rows], SEG)


def test_reconcile(spark):
    u = segment_units(spark, [("s1", 0, "c1", 0, "A", ["e1"], 0.5, None), ("s1", 0, "c2", 1, "B", None, None, 0.3), ("s2", 1, "c1", 0, " a ", ["e2", "e1"], 0.2, 0.9), ("s2", 1, "c2", 1, "b", [], None, 0.1), ("s2", 1, "c3", 2, "C", [], None, None)])
    rel = spark.createDataFrame([("d", "s1", 0, 0, "c1", "c2", "support", 0.6, "first"), ("d", "s2", 1, 0, "c1", "c2", "support", 0.5, "second"), ("d", "s2", 1, 1, "c1", "c3", "attack", -0.4, None), ("d", "s2", 1, 2, "c1", "zz", "attack", 1.0, None)], "doc_id string, segment_id string, seg_ord int, edge_idx int, src string, dst string, kind string, weight double, rationale string")
    m = reconcile.unit_map(u)
    got = {r["new_id"]: r for r in reconcile.merge_units(u, m).collect()}
    assert set(got) == {"c1", "c2", "c3"} and got["c1"]["evidence_ids"] == ["e1", "e2"] and (got["c1"]["evidence_min"], got["c1"]["evidence_max"], got["c1"]["text"]) == (0.2, 0.9, "A")
    assert {(r["new_id"], r["segment_id"]) for r in reconcile.unit_segments(m).collect()} == {("c1", "s1"), ("c1", "s2"), ("c2", "s1"), ("c2", "s2"), ("c3", "s2")}
    w = {(r["src"], r["dst"], r["kind"]): (r["weight"], r["sources"], r["rationale"]) for r in reconcile.merge_relations(rel, m).collect()}
    assert w == {("c1", "c2", "support"): (1.0, 2, "first"), ("c1", "c3", "attack"): (-0.4, 1, None)}
    mean = reconcile.merge_relations(rel, m, reconcile.MergePolicy(relation_aggregation="mean")).collect()
    assert sorted(round(r["weight"], 6) for r in mean) == [-0.4, 0.55]
    assert reconcile.relation_sources(rel, m).count() == 3


def test_reconcile_by_similarity(spark):
    u = segment_units(spark, [("s1", 0, "c1", 0, "Cats are good.", [], None, None), ("s2", 1, "c1", 0, "Cats are very good.", [], None, None), ("s2", 1, "c2", 1, "Dogs bark", [], None, None)])
    m = reconcile.unit_map(u, reconcile.MergePolicy(similarity=reconcile.jaccard, threshold=0.6))
    assert sorted((r["segment_id"], r["unit_id"], r["new_id"]) for r in m.collect()) == [("s1", "c1", "c1"), ("s2", "c1", "c1"), ("s2", "c2", "c2")]


def test_greedy_claim_merge(spark):
    rows = [("d", "s1", 0, 0, "x1", "one two three"), ("d", "s2", 1, 0, "x2", "Three two ONE"), ("d", "s2", 1, 1, "x3", "four"), ("e", "s1", 0, 0, "x4", None)]
    got = reconcile.merge_claims(spark.createDataFrame(rows, "doc_id string, segment_id string, seg_ord int, ord int, claim_id string, text string")).collect()
    assert {r["claim_id"]: (r["new_id"], r["merged"]) for r in got} == {"x1": ("c1", False), "x2": ("c1", True), "x3": ("c2", False), "x4": ("c1", False)}


@pytest.mark.parametrize("best", [True, False])
def test_greedy_rounds_equal_one_walk(spark, best):
    """Many keys that chain into one another, some of them again later: the rounds give what one walk over all pairs gives."""
    rng = random.Random(8)
    rows = []
    for i in range(220):
        base = rng.sample([f"w{n}" for n in range(9)], rng.randint(1, 7)) if rng.random() < 0.8 else rng.choice([[], ["!"], ["w1", "w2"]])
        rows.append((rng.choice("de"), i, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id string, n int, key string").select("doc_id", F.struct("n").alias("at"), "key")
    got = {(r["doc_id"], r["at"]["n"]): (r["root"], r["score"]) for r in reconcile.joined_keys(df, reconcile.jaccard, 0.6, best).collect()}
    want = {}
    for d in "de":
        own = [r for r in rows if r[0] == d]
        want |= {(d, r[1]): x for r, x in zip(own, reconcile.greedy_keys([r[2] for r in own], reconcile.jaccard, 0.6, best), strict=True)}
    assert got == want
    other = reconcile.joined_keys(df, lambda a, b: reconcile.jaccard(a, b), 0.6, best).collect()
    assert {(r["doc_id"], r["at"]["n"]): (r["root"], r["score"]) for r in other} == want


def test_merge_conflicts(spark):
    rows = [("d", "s1", 0, 0, "k", "a"), ("d", "s2", 1, 0, "k", "b"), ("d", "s3", 2, 0, "k", "a"), ("d", "s1", 0, 1, "l", None), ("d", "s2", 1, 1, "l", None)]
    merged, conflicts = reconcile.merge_first(spark.createDataFrame(rows, "doc_id string, segment_id string, seg_ord int, ord int, card_id string, excerpt string"), "card_id", "evidence_card")
    assert {r["card_id"]: r["excerpt"] for r in merged.collect()} == {"k": "a", "l": None}
    assert [(r["key"], r["seg_ord"]) for r in conflicts.collect()] == [("k", 1)]


def test_ordered_rank(spark):
    rng = random.Random(4)
    rows = [(rng.choice("aaaab"), rng.randrange(10**6), i) for i in range(500)]
    got = ordered_rank(spark.createDataFrame(rows, "b string, o int, i int"), ["b"], ["o", "i"], "r").collect()
    for b in "ab":
        want = sorted(r for r in rows if r[0] == b)
        have = sorted((r for r in got if r["b"] == b), key=lambda r: r["r"])
        assert [r["r"] for r in have] == list(range(len(want))) and [(r["b"], r["o"], r["i"]) for r in have] == [(x[0], x[1], x[2]) for x in sorted(want, key=lambda x: (x[1], x[2]))]
    assert re.match("r", "r")


def test_claim_spans_find_titles_of_documents_without_tags(spark, monkeypatch):
    from claimloom.plans import graph_queries as q

    docs = spark.createDataFrame([(1, "on cats and dogs", None, "cats"), (2, "a tag", ["tag"], None)], "doc_id long, text string, tags array<string>, title string")
    monkeypatch.setattr(q, "read_table", lambda spark, d, name: docs)
    assert sorted(tuple(r) for r in q.claim_spans(spark, "").collect()) == [(1, "cats", 3, 7), (2, "tag", 2, 5)]
