import os

import pytest

from claimloom.llm import tokens

VOCABULARY = f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary files here")

TEXTS = [
    None, "", " ", "\n", "Hello world", "  two  spaces ", "it's I'll we'd", "naïve café — “quotes”", "emoji 👩🏽‍💻 🇳🇴", "日本語のテキスト", "Привет, мир", "tab\tand\r\nnewline\n\n\n", "<|endoftext|> <unk> <s>", "a\x00b\x01",
    "1234567890 3.14159", "x" * 5000, "ab" * 3000, "def f(x):\n    return x**2  # ok\n", "​﻿ ", "ﬁ ½ ①", "é", " " * 300 + "x", "▁Ġ▁",
]


@pytest.fixture(scope="module")
def enc():
    return tokens.encoder(VOCABULARY)


def test_same_ids_as_the_public_tokenizer(enc):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for text in TEXTS:
        assert enc.encode(text) == t.encode(text or "", add_special_tokens=False).ids, text


def test_random_unicode_round_trip(enc):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=300, deadline=None)
    @given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
    def check(text):
        assert enc.decode(enc.encode(text)) == text

    check()


def test_columns(spark, enc):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    ids = tokens.encode_texts(df, "doc_id", "text", enc)
    assert ids.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    got = {r["doc_id"]: list(r["ids"]) for r in ids.collect()}
    assert got == {i: enc.encode(t) for i, t in enumerate(TEXTS)}
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(df, "doc_id", "text", enc).collect()} == {i: len(x) for i, x in got.items()}
    assert {r["doc_id"]: r["text"] for r in tokens.decode_ids(ids, "doc_id", "ids", enc).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert tokens.encode_texts(df.where("false"), "doc_id", "text", enc).collect() == []


def test_bad_vocabularies():
    with pytest.raises(ValueError, match="single byte"):
        tokens.serialise_model({b"a": 0})
