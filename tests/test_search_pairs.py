"""Pairs of queries and pool rows: where they are made, and the same relevance wherever that is."""

import pytest
from pyspark.sql import functions as F

from garderobe.plans import search

NONE = "cast(array() as array<string>)"


@pytest.fixture(scope="module")
def tables(spark):
    live = spark.range(60).selectExpr(
        "concat('p', id) as listing_id", "concat('s', id % 3) as source_id", "concat('b', id % 4) as brand", "1000 - id as last_seen_ms", "cast(100 * id as bigint) as usd_cents",
        "array(cast(id % 5 * 2 as int)) as size_normalized", "if(id % 2 = 0, 'midi', 'maxi') as length_class", "concat('silk dress ', id % 7) as title", "cast(null as string) as description",
        "map('color:red', cast(id % 3 - 1 as double), 'shape:wrap', cast(id % 2 as double)) as attribute_vector")
    plans = spark.range(40).selectExpr(
        "id as query_id", "cast(null as bigint) as price_min_cents", "if(id % 4 = 0, cast(3000 as bigint), null) as price_max_cents", "if(id % 3 = 0, array(cast(4 as int)), cast(array() as array<int>)) as sizes",
        f"{NONE} as brands", f"{NONE} as length_classes", f"case id % 4 when 0 then array('color:red', 'color:red', 'shape:wrap') when 1 then array('shape:wrap') else {NONE} end as tags",
        f"if(id % 5 < 2, array('silk', '3'), {NONE}) as residual")
    asked = spark.range(0, 40, 2).selectExpr("id as query_id", "array(cast(id as float), 1f, -2f) as vector")
    vectors = spark.range(0, 60, 3).selectExpr("concat('p', id) as listing_id", "array(1f, cast(id as float), 3f) as vector")
    return plans, live, asked, vectors


def met(plans, live, asked, vectors, top_k=4):
    pools = search.query_pools(plans, live, asked=search.query_side(plans, asked), shown=search.listing_side(plans, live, vectors))
    return search.relevance(plans, pools, live, asked, vectors, top_k)


def listed(df):
    return sorted((r.query_id, r.listing_id, None if r.relevance is None else round(r.relevance, 6)) for r in df.collect())


def test_pairs_are_made_in_place(spark, tables):
    """No join or exchange comes after the one that makes the pairs, and no Python, after which rows have to be shuffled again."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = met(*tables)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    pairs = plan[: plan.index("Join [")]
    assert "Window" in pairs and "Exchange" not in pairs and "Python" not in pairs and "_lot" in plan[plan.index("Join ["):].splitlines()[0]


@pytest.mark.parametrize("repeated", [False, True])
def test_same_as_pairs_joined_with_their_sides(tables, monkeypatch, repeated):
    plans, live, asked, vectors = tables
    if repeated:  # a query id with two rows of other filters, and one that comes twice
        plans = plans.unionByName(plans.filter("query_id < 6").withColumn("query_id", F.col("query_id") % 3))
    monkeypatch.setattr(search, "QUERIES_A_LOT", 3)
    top_k = 1000 if repeated else 4  # which of equal rows is the last of the closest is not said
    joined = search.relevance(plans, search.query_pools(plans, live), live, asked, vectors, top_k)
    rows = listed(met(plans, live, asked, vectors, top_k))
    assert rows == listed(joined) and rows
    assert any(r[2] is None for r in rows) and any(r[2] for r in rows)


def test_a_wanted_tag_twice_counts_twice(tables):
    plans, live, *_ = tables
    rows = {(r.query_id, r.listing_id): r.relevance for r in search.relevance(plans, search.query_pools(plans, live), live).collect()}
    # query 8: tags color:red twice and shape:wrap, no words; p2 carries red only, p5 both
    assert rows[8, "p2"] == pytest.approx(2 / 3) and rows[8, "p5"] == pytest.approx(1.0) and (8, "p0") not in rows


def test_a_batch_of_searches_makes_its_pairs_once(spark, sf, monkeypatch):
    """Nothing of the size of the pairs is staged, and equal ids, whose rows multiply, take the way of joins with the same rows."""
    from garderobe.sources import tables as T
    from workload import search as named

    queries, users = named.asked(spark, sf)
    queries = queries.filter("query_id % 7 = 0")
    staged, stage = [], search.stage
    monkeypatch.setattr(search, "stage", lambda df, label: staged.append(label) or stage(df, label))
    vectors, of_queries = stage(T.embeddings(spark, sf), "v"), named.text_vectors(spark, sf)

    def rows():
        found = search.batch_search(queries, users, T.candidates(spark, sf), T.sources(spark, sf), T.CATALOG_NOW_MS, query_vectors=of_queries, vectors=vectors)
        return found.columns, sorted(found.select("query_id", "position", "listing_id", "rank", "score", F.round("relevance", 6)).collect())

    in_place = rows()
    assert "search-found" not in staged and in_place[1]
    monkeypatch.setattr(search, "unique", lambda df, key: False)
    assert rows() == in_place and "search-found" in staged
