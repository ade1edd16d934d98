"""The mix against its SQL twin and its own promises."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from garderobe.llm import mixing, preferences


@pytest.fixture
def tables(odd, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    return tmp_path


def twin(folder, sql, table):
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet/*.parquet')")
    cursor = con.execute(sql)
    return [c[0] for c in cursor.description], cursor.fetchall()


def test_mix_as_sql(spark, tables):
    names, want = twin(tables, mixing.MIX_SQL, "documents")
    got = mixing.mix_query(spark, str(tables)).select(names).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_promises(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sized = docs.withColumn("size", mixing.size_in_words(F.col("text")))
    once, again = (sorted(map(tuple, mixing.mix(sized).select("doc_id", "copies").collect())) for _ in range(2))
    assert once == again
    for row in mixing.mix(sized).groupBy("source").agg(F.first("target").alias("target"), F.first("source_size").alias("whole"), F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("size").alias("largest"), F.max("copies").alias("most")).collect():
        assert abs(row.taken - row.target) <= row.largest and row.most <= math.ceil(row.target / row.whole) <= 3


def test_targets(spark):
    rows = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    assert got["a"] == 30 and got[None] == 0 and got["b"] == pytest.approx(1980 * 2 / 5) and sum(got.values()) == pytest.approx(2010)


def test_empty_and_repeated(spark, odd, no_docs):
    sized = lambda d: d.withColumn("size", mixing.size_in_words(F.col("text")))
    assert mixing.mix(sized(no_docs)).collect() == []
    mixed = mixing.mix(sized(odd).drop("copies"))
    assert mixing.repeated(mixed).count() == mixed.agg(F.sum("copies")).first()[0]


def test_preferences_as_sql(spark, tmp_path):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", None), (3, 0, None, "x"), (4, 5, "user", ""), (4, None, "system", "s"), (4, 9, "assistant", "long " * 20000),
            (5, 0, None, "x"), (None, 0, "user", "lost"), (None, None, None, None), (6, 1, "assistant", "a"), (6, 1, "assistant", "b"), (6, 1, "user", "b")]
    turns = spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, position int")
    turns.write.parquet(str(tmp_path / "conversations.parquet"))
    names, want = twin(tmp_path, preferences.PREFERENCES_SQL, "conversations")
    got = preferences.preferences_query(spark, str(tmp_path)).select(names).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_preference_sides(spark):
    side = "pair_id long, position long, role string, text string"
    chosen = [(1, 1, "user", "q"), (1, 2, "assistant", "good"), (2, 1, "user", "same"), (3, 1, "user", "q"), (3, 2, "assistant", "more"), (4, 1, "user", "only chosen")]
    rejected = [(1, 1, "user", "q"), (1, 2, "assistant", "bad"), (2, 1, "user", "same"), (3, 1, "user", "q")]
    got = {(r.pair_id, r.part, r.position): (r.rendered, r.train_from) for r in preferences.preference_segments(spark.createDataFrame(chosen, side), spark.createDataFrame(rejected, side)).collect()}
    assert set(got) == {(1, "prompt", 1), (1, "chosen", 2), (1, "rejected", 2), (2, "prompt", 1), (3, "prompt", 1), (3, "chosen", 2), (4, "chosen", 1)}
    text, begin = got[1, "chosen", 2]
    assert text[begin:] == "good<|im_end|>\n" and got[1, "prompt", 1][1] == len(got[1, "prompt", 1][0])
    empty = spark.createDataFrame([], side)
    assert preferences.preference_segments(empty, empty).collect() == []
