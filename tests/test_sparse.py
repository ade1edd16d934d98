"""Nearest sparse maps against brute force: negative weights, ties, several blocks; similar items with fallback."""

import math
import random

import pytest
from pyspark.sql import functions as F

from garderobe.operators.sparse import sparse_top_k
from garderobe.plans import similar


def cosine(a, b):
    na, nb = (math.sqrt(sum(w * w for w in m.values() if w)) for m in (a, b))
    return round(sum(w * b.get(t, 0.0) for t, w in a.items()) / (na * nb), 9) if na and nb else 0.0


def brute(queries, catalog, k):
    out = set()
    for q in queries:
        near = sorted((-cosine(q[1], c[1]), -c[2], c[0]) for c in catalog if cosine(q[1], c[1]) > 0)
        out |= {(q[0], i, r) for r, (_, _, i) in enumerate(near[:k], 1)}
    return out


def maps(rng, n, tags, low):
    return [(i, {t: rng.choice([low, 0.25, 0.5, 1.0]) for t in rng.sample(tags, rng.randint(0, 5))}, rng.randint(0, 3), rng.randint(1, 9)) for i in range(n)]


@pytest.mark.parametrize("k, block_rows, low", [(3, 4096, 0.125), (5, 16, -0.5), (1, 7, 0.0)])
def test_against_brute_force(spark, k, block_rows, low):
    rng = random.Random(k)
    tags = [f"t{i}" for i in range(12)]
    catalog = [(i, {**m, "every": 0.5} if i % 3 else m, tie, price) for i, m, tie, price in maps(rng, 150, tags, low)]
    queries = [(i, {**m, "every": 0.25, "rare": 1.0} if i % 2 else m, 0, most) for i, m, _, most in maps(rng, 60, tags, low)]
    q = spark.createDataFrame([(i, m, most) for i, m, _, most in queries] + [(99, None, 1)], "qid int, tags map<string,double>, most int")
    c = spark.createDataFrame([(i, m, tie, price) for i, m, tie, price in catalog] + [(999, None, 0, 0)], "id int, tags map<string,double>, tie long, price int")
    got = {(r.qid, r.id, r.rank) for r in sparse_top_k(q, c, k, block_rows).collect()}
    assert got == brute(queries, catalog, k) and got


def test_many_tags(spark):
    """More distinct tags than any fixed tag space: every tag is its own list."""
    rows = [(i, {f"tag {i}": 1.0, f"tag {i + 1}": 0.5}) for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, tags map<string,double>")
    got = sparse_top_k(df.withColumnRenamed("id", "qid"), df.withColumn("tie", F.lit(0).cast("long")), 3)
    assert got.count() == 3 * 6000 - 2


def test_fallback_rows(spark):
    rows = [("a", {"x": 1.0}, "sheath", None, 5), ("b", {"x": 0.5, "y": 1.0}, "sheath", "mini", 4), ("c", {}, "sheath", None, 3), ("d", {"z": 1.0}, None, "mini", 2), ("e", None, None, None, 1)]
    pool = spark.createDataFrame(rows, "listing_id string, attribute_vector map<string,double>, silhouette string, length_class string, last_seen_ms long")
    got = sorted((r.probe_id, r.listing_id, r.basis, r["rank"]) for r in similar.similar_by_tags(pool, 2).collect())
    assert got == [("a", "b", "tags", 1), ("b", "a", "tags", 1), ("c", "a", "fallback", 1), ("c", "b", "fallback", 2), ("d", "b", "fallback", 1)]


def test_nothing_to_search(spark):
    none = spark.createDataFrame([], "qid int, tags map<string,double>")
    assert sparse_top_k(none, none.withColumnRenamed("qid", "id").withColumn("tie", F.lit(0).cast("long")), 3).collect() == []
    probes = spark.createDataFrame([(1, {"x": 1.0})], "probe_id int, attribute_vector map<string,double>")
    pool = spark.createDataFrame([], "listing_id string, attribute_vector map<string,double>, last_seen_ms long, confidence double")
    assert similar.nearest_or_newest(probes, pool, 3).collect() == []


@pytest.mark.parametrize("same_ids", [True, False])
def test_probes_asked_more_than_once(spark, same_ids):
    """Probes that are asked once take their list as it is; repeated and missing ids still share one ranking."""
    pool = spark.createDataFrame([(f"p{i}", {"a": 1.0, "b": i / 10}, i) for i in range(6)], "listing_id string, attribute_vector map<string,double>, last_seen_ms long")
    probes = spark.createDataFrame([("p1", {"a": 1.0}), ("x", {"a": 1.0}), ("p2", {"b": 1.0}), ("p2", {"a": 1.0}), (None, {"a": 1.0}), (None, {"a": 1.0}), ("none", {})],
                                   "probe_id string, attribute_vector map<string,double>")
    got = {}
    for r in similar.tag_neighbours(probes, pool, 3, same_ids).collect():
        got.setdefault(r.probe_id, []).append((r["rank"], r.listing_id))
    got = {p: sorted(rows) for p, rows in got.items()}
    near = ["p0", "p1", "p2", "p3"]
    assert got["x"] == list(enumerate(near[:3], 1))
    assert got["p1"] == list(enumerate([p for p in near if p != "p1" or not same_ids][:3], 1))
    assert [r for r, _ in got["p2"]] == [1, 2, 3]
    assert (None in got) != same_ids and (same_ids or [i for _, i in got[None]] == ["p0", "p0", "p1"])
    assert "none" not in got


def test_lists_of_probes_are_not_sorted_again(spark):
    pool = spark.createDataFrame([("p1", {"a": 1.0}, 1)], "listing_id string, attribute_vector map<string,double>, last_seen_ms long")
    probes = spark.range(5).select(F.col("id").alias("probe_id"), F.expr("map('a', 1.0D)").alias("attribute_vector"))
    plan = similar.tag_neighbours(probes, pool, 3, same_ids=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" in plan.lower()
