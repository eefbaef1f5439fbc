"""Dictionaries in texts against plain search."""

import random

import pytest
from pyspark.sql import functions as F

from tracery.functions import phrases
from tracery.functions import text as T

rng = random.Random(4)


def word(n):
    return "".join(rng.choice("abcdé漢 _") for _ in range(n))


@pytest.mark.parametrize("most", [phrases.MOST_CHARS, 40_000])
def test_fifty_thousand_phrases(spark, most):
    """In one automaton, and dealt into several."""
    known = sorted({word(rng.randint(1, 9)) for _ in range(110_000)} | {"a", "aa", "aaa"})
    texts = [(i, word(rng.randint(0, 60))) for i in range(60)] + [(100, None), (101, ""), (102, "aaaa"), (102, "aaaa")]
    df = spark.createDataFrame(texts, "id int, text string").repartition(3)
    table = spark.createDataFrame([(p, f"t{len(p)}") for p in known], "phrase string, token string")
    got = sorted((r["id"], r["phrase"], r["token"]) for r in phrases.phrase_hits(df, "id", table, most=most).collect())
    assert len(known) > 50_000
    assert got == sorted((i, p, f"t{len(p)}") for i, t in texts for p in known if t and p in t)


def test_tokens_in_the_dictionarys_order(spark):
    df = spark.createDataFrame([("the shall not and B1",), ("nothing",), (None,), ("",)], "text string")
    got = [r[0] for r in df.select(phrases.phrase_tokens(F.col("text"), {"and B1": "B", "shall not": "NO", "shall": "B", "": "E"})).collect()]
    assert got == [["B", "NO"], [], [], []]
    assert df.select(T.text_tokens(F.col("text"), (), {"shall not": "NO"}).alias("t")).first()["t"][-1] == "NO"
    with pytest.raises(ValueError, match="phrase_hits"):
        phrases.phrase_tokens(F.col("text"), {"x" * (phrases.MOST_CHARS + 1): "t"})


def test_no_phrases(spark):
    df = spark.createDataFrame([(1, "x")], "id int, text string")
    assert phrases.phrase_hits(df, "id", spark.createDataFrame([], "phrase string, token string")).count() == 0
    assert df.select(phrases.phrase_tokens(F.col("text"), {}).alias("t")).first()["t"] == []
