import itertools

import pytest

from claimloom.llm import lookalikes as lk

ALIKE = [
    ("Ｆｕｌｌ　ｗｉｄｔｈ １２！", "Full width 12!"), ("café", "café"), ("oﬃce ﬁn ﬂy", "office fin fly"),
    ("zero​‍width﻿ soft­hyphen", "zerowidth softhyphen"), ("a b c　d e", "a b c d e"), ("раураl", "paypal"),
    ("ΑΒΕΗ", "ABEH"), ("Ångström K", "Ångström K"), ("текст", "тeкcт"), ("й", "й"), ("", "​"), ("ё", "ë"),
    ("e​́", "é"), ("οδ", "oδ"),
]
DIFFERENT = [
    ("Case", "case"), ("cafe", "café"), ("x²", "x2"), ("①", "1"), ("“q”", '"q"'), ("it’s", "it's"), ("a  b", "a b"), ("a\nb", "a b"), ("a\n", "a"), ("a b", "ab"), ("!", "."), ("ß", "ss"), ("в", "b"), ("Š", "S"), ("½", "1⁄2"),
]


@pytest.mark.parametrize(("a", "b"), ALIKE)
def test_alike(a, b):
    assert lk.appearance(a) == lk.appearance(b) and lk.normalise(a) == lk.normalise(b)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different(a, b):
    assert lk.appearance(a) != lk.appearance(b)


@pytest.mark.parametrize("pair", ["ӀI", "ӏl", "ҮY", "ϹC", "ГΓ", "ПΠ", "ФΦ", "ԜW", "ѴV", "ϜF", "әə", "ΛɅ", "тᴛ", "кκ", "ВΒ", "нʜ", "νѵ", "рρ"])
def test_letters_of_three_scripts(pair):
    a, b = pair
    assert a != b
    for x, y in ((a, b), (b, a), (f"Один {a}.", f"Один {b}."), (a + "\u0301", b + "\u0301")):
        assert lk.appearance(x) == lk.appearance(y) and lk.normalise(x) == lk.normalise(y)


def test_letters_stand_for_one_shape():
    assert all(t not in lk.LOOKALIKES for t in lk.LOOKALIKES.values())
    assert all(len({lk.appearance(k) for k in ks}) == len(ks) for ks in ("Лл", "бb6", "зЗ3", "дΔ", "ιi", "υu", "ηn", "ωw", "ШW"))


def test_a_stock_text_in_many_copies(spark):
    """n copies and one variant make n pairs; nothing of the size of n times n is made on the way."""
    from pyspark.sql import functions as F

    n = 20_000
    df = spark.range(n + 1).select(F.col("id").alias("doc_id"), F.when(F.col("id") == n, "thаnks").otherwise("thanks").alias("text"))
    pairs = lk.lookalike_pairs(df, "doc_id", "text")
    assert pairs.where(f"key_b = {n} and key_a < {n}").count() == pairs.count() == n


def test_normal_form():
    assert lk.normalise("ＣＡＦÉ ① Straße\t​x") == "café 1 strasse x"
    assert lk.normalise(lk.normalise("İẞﬃ ΟΔΟΣ")) == lk.normalise("İẞﬃ ΟΔΟΣ")


def test_normal_form_is_stable():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=300, deadline=None)
    @given(st.text(st.characters(exclude_categories=["Cs"]), max_size=30))
    def check(text):
        assert lk.appearance(lk.appearance(text)) == lk.appearance(text)

    check()


def test_pairs(spark):
    texts = [t for p in ALIKE + DIFFERENT for t in p] + [None, None, "paypal", "paypal", "y" * 200_000, "у" * 200_000]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, look_h string")
    got = [tuple(r) for r in lk.lookalike_pairs(df, "doc_id", "text").collect()]
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2) if a is not None and b is not None and a != b and lk.appearance(a) == lk.appearance(b)}
    assert set(got) == want and len(got) == len(want) > len(ALIKE)
    normal = {r["doc_id"]: r["normal"] for r in lk.normalised_texts(df, "doc_id", "text").collect()}
    assert normal == {i: None if t is None else lk.normalise(t) for i, t in enumerate(texts)}
    assert lk.lookalike_pairs(df.where("false"), "doc_id", "text").collect() == []
