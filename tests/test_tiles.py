"""Fit pools against the rule asked of every pair: partial measures, edges of ranges, vintage labels, absent structs."""

import random

from pyspark.sql import functions as F

from garderobe.functions.sizes import size_compatible
from garderobe.operators.tiles import fit_candidates

BODY = "struct<bust:double,waist:double,hip:double>"
PROFILE = f"profile_id int, sizes array<int>, low long, high long, body {BODY}"
LISTING = (f"listing_id string, source_id string, brand string, last_seen_ms long, usd_cents long, size_normalized array<int>, is_vintage boolean, "
           f"measurements {BODY}, silhouette string")


def measures(rng, at):
    return rng.choice([None, tuple(rng.choice([None, at + rng.randrange(0, 60) / 4]) for at in (at + 6, at, at + 8))])


def rows(rng):
    profiles = [(i, rng.choice([[], [0], [4, 6], [8], [24]]), rng.choice([None, 900]), rng.choice([None, 2500]), measures(rng, 26.0)) for i in range(60)]
    listings = [(f"l{i}", f"s{i % 3}", rng.choice([None, "a", "b"]), rng.randrange(50), rng.randrange(500, 3000),
                 rng.choice([None, [], [2], [4], [6, 8], [14], [26]]), rng.choice([None, False, True]), measures(rng, 26.0),
                 rng.choice([None, "tent", "bodycon", "unheard of"])) for i in range(300)]
    return profiles, listings


def test_against_every_pair(spark):
    profiles, listings = rows(random.Random(5))
    p, c = spark.createDataFrame(profiles, PROFILE), spark.createDataFrame(listings, LISTING)
    fits = size_compatible(F.coalesce("size_normalized", F.array().cast("array<int>")), F.coalesce("is_vintage", F.lit(False)), F.col("measurements"),
                           F.coalesce("silhouette", F.lit("other")), F.col("sizes"), F.col("body"))
    priced = F.col("usd_cents").between(F.coalesce("low", F.lit(0)), F.coalesce("high", F.lit(10**6)))
    want = {(r.profile_id, r.listing_id) for r in p.join(c, fits & priced).select("profile_id", "listing_id").collect()}
    got = [(r.profile_id, r.listing_id) for r in fit_candidates(p, c, 1000).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    measured = {i for i, *_, body in profiles if body and any(body)}
    assert any(i in measured for i, _ in want)


def test_a_cut_pool_is_a_prefix_of_turns(spark):
    """With a cap, sources take turns, also where some of their rows come by measures and some by labels."""
    body = (34.0, 28.0, None)
    p = spark.createDataFrame([(1, [6], None, None, body)], PROFILE)
    c = spark.createDataFrame(
        [(f"m{i}", "s0", "a", i, 1000, [20], False, body, None) for i in range(5)] + [(f"t{i}", "s1", "a", i, 1000, [6], False, None, None) for i in range(5)]
        + [("wide", "s2", "a", 9, 1000, [6], False, (60.0, 28.0, None), None)], LISTING)
    assert {r.listing_id for r in fit_candidates(p, c, 4).collect()} == {"m4", "m3", "t4", "t3"}


def test_nothing(spark):
    none = spark.createDataFrame([], PROFILE)
    assert fit_candidates(none, spark.createDataFrame([], LISTING)).count() == 0
