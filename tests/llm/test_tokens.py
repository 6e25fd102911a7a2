"""Token ids against the public tokenizer itself."""

import random

import pytest
from tokenizers import Tokenizer

from graphloom.llm.tokens import VOCABULARIES, VOCABULARY, decoder, encode

TEXTS = [None, "", " ", "a", "Hello, world!", "Проведение документа по регистру", "x" * 5_000, "é😀­\n\n\t  ", "aaaa" * 300 + "bcbcbc", "<|endoftext|>", "日本語テキスト", "\x00\x01"]


@pytest.fixture(scope="module")
def known():
    return Tokenizer.from_file(f"{VOCABULARIES}/{VOCABULARY}")


def test_ids_are_those_of_the_tokenizer(spark, known):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("абв abc\n.,;(1)\"éß") for _ in range(rng.randrange(400))) for _ in range(60)]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    found = {r["doc_id"]: r["ids"] for r in encode(df, keep=["doc_id"]).collect()}
    assert found == {i: known.encode(t, add_special_tokens=False).ids if t and "<|" not in t else found[i] for i, t in enumerate(texts)}
    assert found[0] == [] and found[1] == []
    of = decoder()
    assert all(b"".join(of[x] for x in found[i]) == (t or "").encode() for i, t in enumerate(texts))


def test_texts_and_other_columns_are_kept(spark):
    df = spark.createDataFrame([("one two", 1, "x"), (None, 2, "y")], "text string, ids int, c0 string")
    kept = encode(df, ids="tokens", count_only=True)
    assert kept.columns == ["text", "ids", "c0", "tokens"]
    assert [tuple(r) for r in kept.orderBy("ids").collect()] == [("one two", 1, "x", 2), (None, 2, "y", 0)]
    assert encode(df.where("false")).collect() == []
