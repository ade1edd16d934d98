"""Candidate pools where measures decide before labels: an interval join of bodies and garments, beside the join of size cells.

Which rule holds for a profile and a listing depends on the parts (bust, waist, hip) that both sides know:

* none: labels. Listings carry the parts that they know into the size cells as a facet, and a profile asks for those that share no part
  with its body. A vintage label is filed under the sizes that it fits.
* some: all of these parts must fit. Garments lie in tiles of the first two common parts; a body asks for the tiles that its range
  touches, and the exact rule is asked after the join.

The two cases share no pair, and each is an equi join. No profile meets the whole catalog.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garderobe.functions.sizes import measurements_fit
from garderobe.operators.cells import profile_key, profile_matches
from garderobe.operators.ranking import stratified_cap
from garderobe.values import CANDIDATE_CAP, FIT_SLACK, FIT_STRETCH, SILHOUETTE_EASE, VINTAGE_SHIFT

PARTS = ("bust", "waist", "hip")
MASKS = range(1, 2 ** len(PARTS))
TILE = 4.0  # inches; a body's range is at most 7 wide, so it touches three tiles a part
NO_CELL = -9  # a vintage label that fits nobody
NONE = -1  # the second coordinate where one part is common


def known_parts(measures: Column) -> Column:
    """Bits of the known parts: 1 bust, 2 waist, 4 hip."""
    bits = [F.when(measures[part].isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, part in enumerate(PARTS)]
    return bits[0] + bits[1] + bits[2]


def fit_profile_key(sizes: Column, low: Column, high: Column, body: Column) -> Column:
    """The key of sizes and prices, with the measures of the body where one is known: equal filters share one pool."""
    parts = F.concat_ws(",", *[F.coalesce(body[part].cast("string"), F.lit("-")) for part in PARTS])
    base = profile_key(sizes, low, high)
    return F.when(known_parts(body) > 0, F.concat_ws("|", base, parts)).otherwise(base)


def fitted_sizes(sizes: Column, is_vintage: Column) -> Column:
    """US sizes that a listing's labels fit: its own, or those a vintage label is shifted down to; empty if it has no label."""
    near, far = VINTAGE_SHIFT
    own = F.coalesce(sizes, F.array().cast("array<int>"))
    shifted = F.array_distinct(F.flatten(F.transform(own, lambda s: F.sequence(s - far, s - near))))
    wearable = F.filter(shifted, lambda s: s >= 0)
    vintage = F.when(F.size(wearable) == 0, F.array(F.lit(NO_CELL))).otherwise(wearable)
    return F.when((F.size(own) > 0) & is_vintage, vintage).otherwise(own)


def _dims(mask: int) -> list[str]:
    return [part for i, part in enumerate(PARTS) if mask >> i & 1][:2]


def _tile(inches: Column) -> Column:
    return F.floor(inches / TILE).cast("long")


def _place(known: int | Column, mask: int, first: Column, second: Column) -> Column:
    known = F.lit(known) if isinstance(known, int) else known
    return F.struct(known.cast("int").alias("known"), F.lit(mask).alias("common"), first.alias("x"), second.alias("y"))


def body_tiles(profiles: DataFrame) -> DataFrame:
    """(profile_id, body, low, high, known, common, x, y): for each set of parts a listing may know, the tiles its garment may lie in.

    Profiles without sizes take every listing, so they ask for none.
    """
    reach = max(SILHOUETTE_EASE.values()) + FIT_SLACK
    body, parts = F.col("body"), known_parts(F.col("body"))

    def touched(part: str) -> Column:
        return F.sequence(_tile(body[part] - FIT_STRETCH), _tile(body[part] + reach))

    asked = []
    for known in MASKS:
        for common in (m for m in MASKS if m & known == m):
            x, *rest = _dims(common)
            ys = touched(rest[0]) if rest else F.array(F.lit(NONE).cast("long"))
            tiles = F.flatten(F.transform(touched(x), lambda i: F.transform(ys, lambda j: _place(known, common, i, j))))
            asked.append(F.when(parts.bitwiseAND(F.lit(known)) == common, tiles))
    rows = profiles.filter((F.size("sizes") > 0) & (parts > 0))
    tiles = F.flatten(F.array_compact(F.array(*asked)))
    return rows.select("profile_id", "body", "low", "high", F.explode(tiles).alias("t")).select("profile_id", "body", "low", "high", "t.*")


def garment_tiles(listings: DataFrame) -> DataFrame:
    """Listings with measures, once for each set of known parts that may be the common one, in the tile of its first two."""
    garment = F.col("measurements")
    parts = known_parts(garment)
    places = []
    for common in MASKS:
        x, *rest = _dims(common)
        y = _tile(garment[rest[0]]) if rest else F.lit(NONE).cast("long")
        places.append(F.when(parts.bitwiseAND(F.lit(common)) == common, _place(parts, common, _tile(garment[x]), y)))
    rows = listings.filter((parts > 0) & F.col("usd_cents").isNotNull())
    return rows.select("listing_id", "source_id", "brand", "last_seen_ms", "usd_cents", "silhouette", garment.alias("garment"),
                       F.explode(F.array_compact(F.array(*places))).alias("t")).select("*", "t.*").drop("t")


def measured_matches(profiles: DataFrame, listings: DataFrame) -> DataFrame:
    """(profile_id, listing_id, source_id, brand, last_seen_ms) where profile and listing know a common part and all of them fit."""
    met = body_tiles(profiles).join(garment_tiles(listings), ["known", "common", "x", "y"])
    priced = F.col("usd_cents").between(F.coalesce("low", "usd_cents"), F.coalesce("high", "usd_cents"))
    return met.filter(priced & measurements_fit(F.col("garment"), F.col("body"), F.coalesce("silhouette", F.lit("other")))).select(
        "profile_id", "listing_id", "source_id", "brand", "last_seen_ms")


def fit_candidates(profiles: DataFrame, listings: DataFrame, cap: int = CANDIDATE_CAP) -> DataFrame:
    """Pools of profiles (profile_id, sizes, low, high, body): the rule of ``size_compatible`` for sizes, and prices.

    A body or garment without any measure, or an absent one, goes by labels. Listings without labels pass, as do all for a profile
    without sizes. Listings without a price are in no pool.
    """
    parts = known_parts(F.col("body"))
    others = F.filter(F.array(*[F.lit(m) for m in range(2 ** len(PARTS))]), lambda m: m.bitwiseAND(parts) == 0)
    any_part = (F.size("sizes") == 0) | (parts == 0)
    asking = profiles.withColumn("f_known", F.when(any_part, F.array().cast("array<string>")).otherwise(others.cast("array<string>")))
    labelled = listings.withColumn("size_normalized", fitted_sizes(F.col("size_normalized"), F.coalesce("is_vintage", F.lit(False))))
    by_label = profile_matches(asking, labelled, cap, {"f_known": known_parts(F.col("measurements")).cast("string")})
    columns = ["profile_id", "listing_id", "source_id", "brand", "last_seen_ms"]
    return stratified_cap(by_label.select(*columns).unionByName(measured_matches(profiles, listings)), ["profile_id"], cap)
