"""Tokens said by texts, against a plain search of each token in each text."""

from pyspark.sql import functions as F

from garderobe.plans.search import said_tokens


def test_said_tokens(spark):
    texts = [("a", "Silk DRESS, silk"), ("b", "undressed\tat 8pm"), ("c", ""), ("d", None), ("e", "x" * 3000 + "ress"), ("f", "a'b")]
    tokens = ["silk", "dress", "ress", "8", "at", "'b", "missing", "silk", "dress,"]
    found = said_tokens(spark.createDataFrame(texts, "listing_id string, text string"), spark.createDataFrame([(t,) for t in tokens], "token string"), F.col("text"))
    got = {r.listing_id: set(r.said) for r in found.collect()}
    want = {i: {k for k in tokens if k in t.lower()} for i, t in texts if t}
    assert got == {i: s for i, s in want.items() if s}


def test_nothing_asked(spark):
    texts = spark.createDataFrame([("a", "silk")], "listing_id string, text string")
    assert said_tokens(texts, spark.createDataFrame([], "token string"), F.col("text")).count() == 0
