"""Candidate retrieval for many filter profiles at once, without pairing profiles with the whole catalog.

A profile is a distinct (sizes, price range). Listings are filed under (size cell, price node) keys, where price nodes are
the blocks of a radix tree over US cents; a profile's price range is exactly covered by a few blocks. Profiles and
listings then meet in an equi join.

Each (cell, node, source) file keeps only the rows that can be among the first ``cap`` of a source's brand round-robin.
That cut is exact for any union of files: adding rows from other files to a source can only push a row further back in
the round-robin, never forward.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garderobe.operators.ranking import fair_rank, stratified_cap
from garderobe.values import CANDIDATE_CAP

RADIX = 16
LEVELS = 8
DOMAIN = RADIX**LEVELS
ANY_SIZE = -2
NO_SIZE = -1
ANY = "*"


def profile_key(sizes: Column, low: Column, high: Column) -> Column:
    return F.concat_ws(
        "|", F.array_join(F.array_sort(sizes).cast("array<string>"), ","), F.coalesce(low.cast("string"), F.lit("-")),
        F.coalesce(high.cast("string"), F.lit("-")),
    )


def _blocks() -> Column:
    """Array of (level, node) exactly covering [lo, hi): nodes whose parent block is not wholly inside."""
    per_level = []
    for level in range(LEVELS):
        unit, parent = RADIX**level, RADIX ** (level + 1)
        left, right = f"ceil(lo / {unit})", f"floor(hi / {unit})"
        if level == LEVELS - 1:
            spans = [(left, right)]
        else:
            left_end = f"least({RADIX} * ceil(lo / {parent}), {right})"
            right_start = f"greatest({RADIX} * floor(hi / {parent}), {left_end}, {left})"
            spans = [(left, left_end), (right_start, right)]
        for start, stop in spans:
            per_level.append(
                f"if({start} < {stop}, transform(sequence(cast({start} as bigint), cast({stop} as bigint) - 1), "
                f"n -> named_struct('level', {level}, 'node', n)), array())"
            )
    return F.expr(f"concat({', '.join(per_level)})")


def profile_cells(profiles: DataFrame, facets: list[str]) -> DataFrame:
    """(profile_id, cell, level, node, facets...) rows. Prices are whole cents, so [low, high] is [low, high + 1).

    A facet column holds the wanted values as an array; an empty one files the profile under "any value".
    """
    bounded = profiles.select(
        "profile_id", "sizes", *facets,
        F.greatest(F.coalesce("low", F.lit(0)), F.lit(0)).cast("long").alias("lo"),
        F.least(F.coalesce(F.col("high") + 1, F.lit(DOMAIN)), F.lit(DOMAIN)).cast("long").alias("hi"),
    )
    cells = F.when(F.size("sizes") == 0, F.array(F.lit(ANY_SIZE))).otherwise(
        F.array_append(F.col("sizes"), F.lit(NO_SIZE))
    )
    rows = bounded.select("profile_id", cells.alias("cells"), *facets, F.explode(_blocks()).alias("b"))
    rows = rows.select("profile_id", F.explode("cells").alias("cell"), *facets, "b.level", "b.node")
    for facet in facets:
        rows = rows.withColumn(facet, F.explode(F.when(F.size(facet) == 0, F.array(F.lit(ANY))).otherwise(F.col(facet))))
    return rows


def listing_cells(listings: DataFrame, facets: dict[str, Column]) -> DataFrame:
    """Listings once per (size cell, price level, facet value or any); ``usd_cents`` picks the node of each level."""
    cells = F.when(F.size("size_normalized") == 0, F.array(F.lit(NO_SIZE))).otherwise(F.col("size_normalized"))
    nodes = F.array(*[
        F.struct(F.lit(level).alias("level"), F.floor(F.col("_clipped") / RADIX**level).cast("long").alias("node"))
        for level in range(LEVELS)
    ])
    rows = listings.withColumns({
        "_clipped": F.least(F.col("usd_cents"), F.lit(DOMAIN - 1)),
        **{f"_f_{name}": value for name, value in facets.items()},
    }).withColumn("cell", F.explode(F.array_append(cells, F.lit(ANY_SIZE)))).withColumn("_n", F.explode(nodes))
    for name in facets:
        both = F.array_compact(F.array(F.lit(ANY), F.col(f"_f_{name}")))
        rows = rows.withColumn(f"_f_{name}", F.explode(both))
    return rows.select("listing_id", "source_id", "brand", "last_seen_ms", "cell", "_n.level", "_n.node",
                       *[F.col(f"_f_{name}").alias(name) for name in facets])


def profile_matches(profiles: DataFrame, listings: DataFrame, cap: int = CANDIDATE_CAP,
                    facets: dict[str, Column] | None = None) -> DataFrame:
    """(profile_id, listing_id, ...) of the rows that can be in a profile's pool, each once; more than ``cap`` a profile."""
    facets = facets or {}
    wanted = profile_cells(profiles, list(facets))
    keys = ["cell", "level", "node", *facets]
    filed = listing_cells(listings, facets).join(wanted.select(*keys).distinct(), keys, "left_semi")
    kept = fair_rank(filed, keys, cap).drop("_rs")
    return wanted.join(kept, keys).drop(*keys).dropDuplicates(["profile_id", "listing_id"])


def profile_candidates(profiles: DataFrame, listings: DataFrame, cap: int = CANDIDATE_CAP,
                       facets: dict[str, Column] | None = None) -> DataFrame:
    """(profile_id, listing_id, ...) rows of each profile's source-fair, brand-spread candidate pool."""
    return stratified_cap(profile_matches(profiles, listings, cap, facets), ["profile_id"], cap)
