import random

import pytest
from pyspark.sql import functions as F

from tidelog.llm import tokens

TEXTS = [
    None, "", " ", "\n\n  x", "It's we'll I'M don't  'S", "a<|endoftext|>b", "12345 67,890.1", "héé naïve ﬁ ß İ", "数据 カタカナ 시장 рынок", "​﻿\x00\x1c\x85 　 y", "🙂👍🏽 🇩🇪", "tab\t\ttab\r\n",
    "   trailing   ", "''s''re", "²³½ Ⅷ", "áë", "\U00031350 x", "﷐ y", "x" * 500, " ".join(["word"] * 3000),
]


def expected(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.VOCABULARY)
    tokenizer.encode_special_tokens = True
    return [tokenizer.encode(t, add_special_tokens=False).ids if t else [] for t in texts]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"ids": F.lit("clash"), "word": F.lit(1), "h": F.lit(2)})


def test_ids_equal_the_tokenizers(spark, work):
    got = {r.doc_id: r.ids for r in tokens.token_ids(frame(spark, TEXTS), work).collect()}
    assert got == dict(enumerate(expected(TEXTS)))


def test_rare_words_are_joined_by_shuffle(spark, work, monkeypatch):
    monkeypatch.setattr(tokens, "HOT_WORDS", 2)
    got = {r.doc_id: r.ids for r in tokens.token_ids(frame(spark, TEXTS), work).collect()}
    assert got == dict(enumerate(expected(TEXTS)))


def test_random_texts_and_round_trip(spark, work):
    random.seed(8)
    alphabet = "ab'sdtlmrev 1² \n\t.,-éß中🙂  ́_"
    texts = ["".join(random.choices(alphabet, k=random.randrange(60))) for _ in range(800)]
    ids = tokens.token_ids(frame(spark, texts), work).cache()
    assert {r.doc_id: r.ids for r in ids.collect()} == dict(enumerate(expected(texts)))
    assert {r.doc_id: r.text or "" for r in tokens.decoded(ids).collect()} == dict(enumerate(texts))
    ids.unpersist()


def test_every_code_point_is_cut_alike(spark, work):
    points = [c for c in range(0x2FFFF) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{chr(c)}1{chr(c)} {chr(c)}" for c in points[i : i + 300]) for i in range(0, len(points), 300)]
    got = {r.doc_id: r.ids for r in tokens.token_ids(frame(spark, texts), work).collect()}
    # texts with code points that Java does not know go another way, so every known one is also tried alone
    assert got == dict(enumerate(expected(texts)))
    known = [c for c in random.Random(1).sample(points, 4000) if c > 127]
    alone = [f"a{chr(c)}1{chr(c)} {chr(c)}" for c in known]
    got = {r.doc_id: r.ids for r in tokens.token_ids(frame(spark, alone), work + "2").collect()}
    assert got == dict(enumerate(expected(alone)))


def test_repeated_rows_and_empty_table(spark, work):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (2, None), (2, None), (None, "a b")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, tuple(r.ids)) for r in tokens.token_ids(df, work).collect())
    (a, c) = (tuple(x) for x in expected(["a b", "c"]))
    assert got == sorted([(1, a), (1, c), (2, ()), (-1, a)])
    assert tokens.token_ids(df.limit(0), work + "2").collect() == []


def test_very_long_texts(spark, work):
    text = " ".join(f"w{i % 977} and" for i in range(150_000))
    assert {r.doc_id: r.ids for r in tokens.token_ids(frame(spark, [text, text + "!"]), work).collect()} == dict(enumerate(expected([text, text + "!"])))


def test_decoding_invalid_ids(spark):
    df = spark.createDataFrame([(1, []), (2, [50256])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in tokens.decoded(df).collect()} == {1: "", 2: "<|endoftext|>"}


@pytest.mark.parametrize("path", ["/no/such/file"])
def test_vocabulary_is_a_parameter(spark, work, path):
    with pytest.raises(FileNotFoundError):
        tokens.token_ids(frame(spark, ["x"]), work, path)
