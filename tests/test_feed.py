"""Pairs of users and pool rows: where they are made and ranked."""

from garderobe.plans import feed
from garderobe.sources import tables as T


def ranked(spark, sf):
    users = T.users(spark, sf)
    live = feed.live_catalog(T.candidates(spark, sf), T.sources(spark, sf), T.CATALOG_NOW_MS)
    return feed.ranked(feed.scored_pairs(users, live, feed.pools(users, live), T.CATALOG_NOW_MS)), users


def test_pairs_are_not_shuffled(spark, sf):
    rows, _ = ranked(spark, sf)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange" not in plan[plan.index("Window"):plan.index("BroadcastHashJoin")]


def test_many_pool_rows_give_the_same_ranks(spark, sf, monkeypatch):
    few, _ = ranked(spark, sf)
    monkeypatch.setattr(feed, "MOST_SENT", 0)
    many, _ = ranked(spark, sf)
    columns = ["user_id", "listing_id", "rank", "score", "hem.position", "hem.basis", "palette_match"]
    assert few.count() > 0
    assert few.select(*columns).exceptAll(many.select(*columns)).isEmpty() and many.select(*columns).exceptAll(few.select(*columns)).isEmpty()


def test_tags_and_colors_of_a_pair(spark):
    """Dot products and palette hits against plain loops: tags of one side, empty sides, colors without a code or a name, colors that are absent."""
    from pyspark.sql import functions as F

    tags = [{}, {"a": 0.1, "b": -0.7, "c": 0.3}, {"c": 0.9, "d": 2.0, "a": 1 / 3}, {"e": 1.0}, None]
    colors = [[], [("red", "#DC143C"), (None, "#000080")], [(" RED", None), ("", "#0000CD")], [("", None), None], [("x", "#00008G"), ("navy", "0000b0")], None]
    schema = "id int, tags map<string, double>, colors array<struct<name: string, hex: string>>"
    side = spark.createDataFrame([(i * 10 + j, t, c) for i, t in enumerate(tags) for j, c in enumerate(colors)], schema)
    left = side.select(F.col("id").alias("l"), *feed._tags("tags", "l"), feed._swatches("colors").alias("l_colors"))
    right = side.select(F.col("id").alias("u"), *feed._tags("tags", "u"), feed._swatches("colors").alias("u_colors"))

    def parsed(color):
        name, code = color or (None, None)
        code = code.lstrip("#") if code else ""
        return (name or "").strip().lower(), tuple(int(code[k:k + 2], 16) for k in (0, 2, 4)) if len(code) == 6 and all(c in "0123456789abcdefABCDEF" for c in code) else None

    def hit(a, b):
        return bool(a[0]) and a[0] == b[0] or bool(a[1] and b[1]) and sum((x - y) ** 2 for x, y in zip(a[1], b[1])) <= 80 ** 2

    for r in left.crossJoin(right).select("l", "u", feed._tags_dot().alias("dot"), feed._palette_hits().alias("hits")).collect():
        a, b, x, y = tags[r.l // 10], tags[r.u // 10], colors[r.l % 10], colors[r.u % 10]
        assert r.dot == (None if a is None or b is None else sum((w * b[k] for k, w in a.items() if k in b), 0.0))
        assert r.hits == (None if x is None else sum(any(hit(parsed(c), parsed(p)) for p in y or []) for c in x))


def test_pairs_look_up_no_text(spark, sf):
    """Tags of a pair meet as numbers: the whole list of a listing is not searched by text in a user's map for each pair."""
    plan = ranked(spark, sf)[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" in plan and "u_tags" not in plan
