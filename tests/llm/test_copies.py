import json
import random
import re
import unicodedata

from pyspark.sql import functions as F

from claimloom.llm import copies


def word_key(text):
    out, run = [], ""
    for ch in (text or "").lower():
        if unicodedata.category(ch)[0] in "LN":
            run += ch
        elif run:
            out.append(run)
            run = ""
    return tuple(out + ([run] if run else []))


def groups(spark, rows):
    df = spark.createDataFrame(rows, "tbl string, key string, text string, pairs int, f1 int")
    got = copies.copy_groups(df, ["tbl"], "key", {"text": copies.words(F.col("text"))})
    out = [(r["tbl"], r["key"], r["first_key"]) for r in got.collect()]
    assert len(out) == len(set(out))
    return set(out)


def brute(rows):
    by = {}
    for t, k, x, *_ in rows:
        if k is not None and word_key(x):
            by.setdefault((t, word_key(x)), set()).add(k)
    return {(t, k, min(ks)) for (t, _), ks in by.items() if len(ks) > 1 for k in ks}


def test_matches_brute_force(spark):
    rng = random.Random(5)
    base = ["Élan vital, über 3 straße", "a b c", "c b a", "ΟΔΟΣ und Οδός", "it's 45.9 %", "x" * 50_000, "", "...", None, "a b  c 漢字"]
    rows = []
    for i in range(400):
        t = rng.choice(base)
        if t and rng.random() < 0.7:
            t = re.sub(" ", lambda m: rng.choice([" ", "  ", " ", " - ", "\n"]), t)
            t = t.upper() if rng.random() < 0.2 and "ß" not in t and "Σ" not in t else t
        rows.append((rng.choice("uw"), f"k{i:03}", t, 1, 1))
    rows += rows[:50] + [("u", None, "a b c", 1, 1)]
    assert groups(spark, rows) == brute(rows) != set()


def test_fields_in_any_order(spark):
    one = {"lang": "en", "batch": 7, "tags": ["x"]}
    rows = [("k1", "A b", json.dumps(one)), ("k2", "a  B!", json.dumps(dict(reversed(one.items())))), ("k3", "a b", json.dumps(one | {"batch": 8})), ("k4", "a b", None), ("k5", "a b", "{broken"), ("k6", None, json.dumps(one))]
    df = spark.createDataFrame(rows, "key string, text string, metadata string")
    got = copies.copy_groups(df, [], "key", {"text": copies.words(F.col("text"))}, ("metadata",)).collect()
    assert {(r["key"], r["first_key"]) for r in got} == {("k1", "k1"), ("k2", "k1"), ("k4", "k4"), ("k5", "k4")}


def test_collisions_are_separated(spark, monkeypatch):
    monkeypatch.setattr(copies, "_multiset_hash", lambda pairs, seed: F.lit(1).cast("bigint"))
    rows = [("u", "k1", "a", 1, 1), ("u", "k2", "b", 1, 1), ("u", "k3", "b", 1, 1), ("u", "k4", "c", 1, 1), ("u", "k5", "A!", 1, 1)]
    assert groups(spark, rows) == brute(rows) == {("u", "k1", "k1"), ("u", "k5", "k1"), ("u", "k2", "k2"), ("u", "k3", "k2")}


def test_one_hot_text_and_counts(spark):
    rows = [("u", f"k{i:05}", f"Same, text{'!' * (i % 3)}", 1, 1) for i in range(3000)]
    df = spark.createDataFrame(rows, "tbl string, key string, text string, pairs int, f1 int")
    g = copies.copy_groups(df, ["tbl"], "key", {"text": copies.words(F.col("text"))})
    assert [tuple(r) for r in copies.copy_counts(g, ["tbl"], "key").collect()] == [("u", "k00000", 3000)]


def test_empty(spark):
    assert groups(spark, []) == set()


def test_queries_keep_single_texts_and_compare_both_tables(spark, monkeypatch):
    from claimloom.llm import queries

    rows = lambda *xs: [(k, t, "fact", m) for k, t, m in xs]
    tables = {
        "units": spark.createDataFrame(rows(("c1", "One  text", None), ("c2", "one TEXT", None), ("c2", "one TEXT", None), ("c3", "alone", None), ("c4", "!", None)), "unit_id string, text string, type string, metadata string"),
        "warrants": spark.createDataFrame(rows(("w1", "same", '{"a": "1", "b": "2"}'), ("w2", "Same", '{"b": "2", "a": "1"}'), ("w3", "same", '{"a": "9"}')), "warrant_id string, text string, type string, metadata string"),
    }
    monkeypatch.setattr(queries, "read_table", lambda spark, d, name: tables[name])
    got = {(r["table_name"], r["first_key"], r["words"], r["copies"]) for r in queries.p5_texts(spark, "").collect()}
    assert got == {("units", "c1", "one text", 2), ("units", "c3", "alone", 1), ("warrants", "w1", "same", 3)}
    same = {(r["table_name"], r["first_key"], r["copy_key"], r["copies"]) for r in queries.p5_same_records(spark, "").collect()}
    assert same == {("units", "c1", "c2", 2), ("warrants", "w1", "w2", 2)}
