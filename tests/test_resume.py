"""Streams that stop and go on: the second run gives what one batch over all input gives."""

import random

import pytest
from pyspark.sql import functions as F

from garderobe.plans.taste import style_tags
from garderobe.streaming import jobs
from garderobe.streaming.runtime import file_stream
from garderobe.streaming.state import StateTable


def write(spark, folder, rows, schema):
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)


def test_style_vectors_go_on(spark, tmp_path):
    rng, folder, home = random.Random(2), str(tmp_path / "swipes.parquet"), str(tmp_path / "home")
    schema = "swipe_id long, user_id string, listing_id string, verdict string, created_ms long"
    parts = [[(100 * p + i, f"u{rng.randint(0, 9)}", f"l{rng.randint(0, 5)}", rng.choice(["like", "save", "dislike", "skip"]), 1000 * p + i) for i in range(60)] for p in range(4)]
    parts[3] = [r for r in parts[3] if r[1] == "u1"]  # a batch that touches one bucket
    vectors = spark.createDataFrame([(f"l{i}", {"a": 0.5, f"t{i % 3}": 1.0}) for i in range(6)], "listing_id string, attribute_vector map<string,double>")
    write(spark, folder, parts[:2], schema)
    stream = file_stream(spark, folder, "*.parquet", files_per_trigger=1)
    first = jobs.style_vectors(stream, vectors, home=home)
    assert {(r.user_id, r.tag, round(r.value, 9)) for r in first.collect()} == {(r.user_id, r.tag, round(r.value, 9)) for r in style_tags(spark.createDataFrame(parts[0] + parts[1], schema), vectors).collect()}
    write(spark, folder, parts[2:], schema)
    got = {(r.user_id, r.tag, round(r.value, 9)) for r in jobs.style_vectors(stream, vectors, home=home).collect()}
    assert got == {(r.user_id, r.tag, round(r.value, 9)) for r in style_tags(spark.createDataFrame(sum(parts, []), schema), vectors).collect()}
    last = spark.read.parquet(f"{home}/style-state/data/v=3")
    assert {r.user_id for r in last.collect()} >= {"u1"} and len(last.select("bucket").distinct().collect()) == 1


def test_aggregates_go_on(spark, tmp_path):
    folder, home = str(tmp_path / "runs.parquet"), str(tmp_path / "home")
    schema = "source_id string, status string, started_ms long"
    write(spark, folder, [[("a", "ok", 1), ("b", "ok", 2)], [("a", "error", 9)]], schema)
    stream = file_stream(spark, folder, "*.parquet", files_per_trigger=1)
    assert {(r.source_id, r.last_ok_ms) for r in jobs.last_success(stream, home).collect()} == {("a", 1), ("b", 2)}
    write(spark, folder, [[("a", "ok", 5), ("c", "ok", 7)]], schema)
    assert {(r.source_id, r.last_ok_ms) for r in jobs.last_success(stream, home).collect()} == {("a", 5), ("b", 2), ("c", 7)}
    assert {(r.source_id, r.last_ok_ms) for r in jobs.last_success(stream, home).collect()} == {("a", 5), ("b", 2), ("c", 7)}  # nothing new


def added(before, changes):
    both = before.select("k", "n").unionByName(changes)
    return both.groupBy("k").agg(F.sum("n").alias("n"))


def test_state_table_replays(spark, tmp_path):
    """A version counts once its manifest stands; a batch that comes again starts from the versions before it."""
    table = StateTable(spark, str(tmp_path / "state"), ["k"], "k string, n long", buckets=4)
    assert table.current().collect() == [] and table.versions() == {}
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "k string, n long")
    held = lambda: {r.k: r.n for r in table.current().collect()}
    table.advance(rows(("a", 1), ("b", 1), (None, 4)), 0, added)
    table.advance(rows(("a", 2)), 1, added)
    assert held() == {"a": 3, "b": 1, None: 4}
    table.advance(rows(("a", 2)), 1, added)
    assert held() == {"a": 3, "b": 1, None: 4}
    table.bucketed(rows(("a", 99))).write.partitionBy("bucket").parquet(f"{table.folder}/data/v=2")  # stopped before the manifest
    assert held() == {"a": 3, "b": 1, None: 4}
    table.advance(rows(("c", 1)), 2, added)
    assert held() == {"a": 3, "b": 1, "c": 1, None: 4}
    table.advance(rows(), 3, added)
    assert held() == {"a": 3, "b": 1, "c": 1, None: 4}


@pytest.mark.parametrize("name", ["stream_catalog_feed", "stream_style_vectors", "stream_error_hours", "stream_deck_completions", "stream_stale_sources"])
def test_registered_streams_run(spark, sf, name):
    from workload import QUERIES
    assert QUERIES[name](spark, sf).count() > 0


def test_a_user_with_very_many_swipes(spark, tmp_path):
    """One user has most rows of a batch, in many chunks and no order: the deck ends where a walk in order ends it."""
    rng, folder = random.Random(8), str(tmp_path / "swipes.parquet")
    rows = [(i, "hot" if i % 10 else f"u{i % 70}", "like" if rng.random() < 0.1 else "skip", rng.randrange(10**6)) for i in range(30_000)]
    write(spark, folder, [rows], "swipe_id long, user_id string, verdict string, created_ms long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        got = {r.user_id: (r.reason, r.at_ms, r.positives, r.cards) for r in jobs.deck_completions(file_stream(spark, folder, "*.parquet")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for user in {r[1] for r in rows}:
        likes = 0
        for n, (_, _, verdict, at) in enumerate(sorted((r for r in rows if r[1] == user), key=lambda r: (r[3], r[0])), 1):
            likes += verdict == "like"
            if likes >= jobs.LIKE_TARGET or n >= jobs.CARD_CAP:
                want[user] = ("target" if likes >= jobs.LIKE_TARGET else "cap", at, likes, n)
                break
    assert got == want and "hot" in got


def test_a_version_holds_changed_rows_only(spark, tmp_path):
    """A batch writes the rows of its keys, not the buckets they are in, until so many changed that a bucket is written whole."""
    table = StateTable(spark, str(tmp_path / "state"), ["k"], "k string, n long", buckets=2)
    rows = lambda pairs: spark.createDataFrame(list(pairs), "k string, n long")
    want = {f"k{i}": i for i in range(12)} | {None: 7}
    table.write(rows(want.items()), -1, {})
    written = []
    for v in range(12):
        table.advance(rows([(f"k{v}", 100), (None, 1)] if v == 3 else [(f"k{v}", 100)]), v, added)
        want |= {f"k{v}": v + 100} | ({None: 8} if v == 3 else {})
        written.append(spark.read.parquet(f"{table.folder}/data/v={v}").count())
        if v in (0, 3, 11):
            assert {r.k: r.n for r in table.current().collect()} == want
    assert written[:4] == [1, 1, 1, 2] and sum(written) < 4 * 13 and max(written) > 2
