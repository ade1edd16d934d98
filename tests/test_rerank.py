"""An outside ranking merged over ranked pairs, against a plain loop."""

from pyspark.sql import functions as F

from garderobe.plans import feed

ROWS = [(u, f"p{i}", i, 1 - i / 40) for u in (1, 2, None) for i in range(30)] + [(3, None, 0, 0.5), (3, "p1", 1, 0.25)]
NAMED = [(1, "p5", 2), (1, "p9", 1), (1, "p9", 1), (1, "p3", None), (1, "p28", 1), (1, "p28", 7), (2, "gone", 1), (None, "p4", 1), (3, None, 1), (3, "p1", 0)]


def merged(rows, named, head=24):
    out = []
    for user in {r[0] for r in rows}:
        own = []
        for u, item, rank, score in rows:
            if u == user:
                places = [p for v, x, p in named if u is not None and item is not None and (v, x) == (u, item)] or [None]
                own += [(rank >= head, 0 if rank >= head else 2**30 if p is None else p, rank, item, score) for p in places]
        own.sort(key=lambda r: r[:3])
        n = sum(not r[0] for r in own)
        for new, (tail, _, _, item, score) in enumerate(own):
            out.append((user, item, new, round(score if tail else 0.6 * (1 if n <= 1 else 1 - new / (n - 1)) + 0.4 * score, 6)))
    return sorted(out, key=repr)


def test_named_items(spark):
    rows = spark.createDataFrame(ROWS, "user_id long, listing_id string, rank int, score double")
    got = feed.apply_rerank(rows, spark.createDataFrame(NAMED, "user_id long, listing_id string, place long"))
    assert got.columns == ["user_id", "listing_id", "rank", "score"]
    assert sorted(((r.user_id, r.listing_id, r["rank"], round(r.score, 6)) for r in got.collect()), key=repr) == merged(ROWS, NAMED)


def test_pairs_stay_with_their_users(spark):
    rows = spark.createDataFrame([r for r in ROWS if r[0]], "user_id long, listing_id string, rank int, score double").repartition(3, "user_id")
    external = rows.filter("rank % 3 = 0").select("user_id", "listing_id", F.col("rank").alias("place"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = feed.apply_rerank(rows, external)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") and "hashpartitioning(user_id" in plan
