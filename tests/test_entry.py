"""Every SQL twin has a query, and a sample of both agrees at the smallest size."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["funnel", "top_searches", "stratified_cap", "source_health", "profile_pools_30", "style_tags_live", "snapshot_upsert", "search_interpreted", "similar_by_tags", "storefront_listings",
          "page_listings", "crawl_plan", "stream_error_hours"]


def test_twins_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 2


@pytest.mark.parametrize("name", SAMPLE)
def test_twin(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    cursor = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    want = sorted((tuple(r) for r in cursor.fetchall()), key=repr)
    got = entry.queries()[name](spark, sf).select(*[f"`{n}`" for n in names])
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
