"""Ranked, diversified feeds for all users at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garderobe.functions import hem as H
from garderobe.functions import scoring as S
from garderobe.functions.vectors import pair_cosine
from garderobe.operators.cells import profile_candidates, profile_key
from garderobe.operators.diversity import interleave, spread_key
from garderobe.operators.filters import active, adult, usd_price, within_freshness
from garderobe.operators.ranking import page
from garderobe.operators.tiles import fit_candidates, fit_profile_key
from garderobe.session import stage
from garderobe.values import CANDIDATE_CAP, PALETTE_BOOST_MAX, PALETTE_HEX_DISTANCE, RERANK_HEAD

SCORE_DIGITS = 9  # scores equal to nine decimals are ties
MOST_SENT = 200_000  # pool rows that are sent to every executor, some hundred bytes each
USERS_A_TASK = 2_000  # each with a pool of up to the cap


def _channels(code: str) -> str:
    hex6 = f"regexp_extract(trim({code}), '(?i)^#?([0-9a-f]{{6}})$', 1)"
    return ", ".join(
        f"'{name}', cast(conv(nullif(substring({hex6}, {at}, 2), ''), 16, 10) as double)" for name, at in
        (("r", 1), ("g", 3), ("b", 5))
    )


def _swatches(column: str) -> Column:
    """Colors as (name, r, g, b, n): parsed once per user or listing, so that pairs only do arithmetic; ``n`` is the square of the norm."""
    parsed = f"transform({column}, c -> named_struct('name', nullif(lower(trim(c.name)), ''), {_channels('c.hex')}))"
    return F.expr(f"transform({parsed}, c -> named_struct('name', c.name, 'r', c.r, 'g', c.g, 'b', c.b, 'n', c.r * c.r + c.g * c.g + c.b * c.b))")


def _palette_hits() -> Column:
    """Colors of the listing that have the name of one of the palette or lie near it: channels are whole numbers, so squares are exact."""
    near = f"c.n + p.n - 2.0D * (c.r * p.r + c.g * p.g + c.b * p.b) <= {PALETTE_HEX_DISTANCE ** 2}D"
    return F.expr(f"size(filter(l_colors, c -> exists(u_colors, p -> p.name = c.name or {near})))")


def _tags(column: str, side: str) -> list[Column]:
    """Tags as hashes of their keys and weights, and their norm."""
    return [F.expr(f"transform(map_keys({column}), k -> xxhash64(k))").alias(f"{side}_keys"), F.map_values(column).alias(f"{side}_weights"),
            F.expr(_norm(f"map_entries({column})")).alias(f"{side}_norm")]


def _tags_dot() -> Column:
    """Over the tags that both sides have, in the listing's order; a weight that is missing makes the norm NULL already."""
    of = "get({0}_weights, cast(array_position({0}_keys, k) as int) - 1)"
    return F.expr(f"aggregate(array_intersect(l_keys, u_keys), 0.0D, (s, k) -> s + {of.format('l')} * {of.format('u')})")


def live_catalog(catalog: DataFrame, sources: DataFrame, now_ms: int) -> DataFrame:
    return within_freshness(catalog.filter(active() & adult()), sources, now_ms).withColumn("usd_cents", usd_price())


def with_profile(users: DataFrame, size_mode: str = "labels") -> DataFrame:
    if "profile_id" in users.columns:
        return users
    filters = [F.col("sizes"), F.col("budget_min_cents"), F.col("budget_max_cents")]
    return users.withColumn("profile_id", fit_profile_key(*filters, F.col("body")) if size_mode == "fit" else profile_key(*filters))


def pools(users: DataFrame, live: DataFrame, cap: int = CANDIDATE_CAP, size_mode: str = "labels") -> DataFrame:
    """Candidate pool per distinct profile; users with equal filters share one pool.

    ``size_mode``: "labels" compares sizes, "fit" asks measures of the body first where it and the garment have some.
    """
    if size_mode not in ("labels", "fit"):
        raise ValueError(f"unknown size mode {size_mode}")
    own = ["body"] if size_mode == "fit" else []
    profiles = with_profile(users, size_mode).select(
        "profile_id", "sizes", F.col("budget_min_cents").alias("low"), F.col("budget_max_cents").alias("high"), *own
    ).dropDuplicates(["profile_id"])
    return fit_candidates(profiles, live, cap) if own else profile_candidates(profiles, live, cap)


def _norm(entries: str) -> str:
    return f"sqrt(aggregate({entries}, 0.0D, (s, e) -> s + e.value * e.value))"


def _met(users: DataFrame, pooled: DataFrame) -> DataFrame:
    """Users with the rows of their profile's pool.

    Pools that many users share are few rows: they are sent to the tasks, users are dealt out by ``user_id`` in small lots, and what
    ranks pairs by user finds them in place, so no pair is shuffled. More rows than ``MOST_SENT`` meet their users by profile.
    """
    pooled = stage(pooled, "pooled")
    if pooled.limit(MOST_SENT + 1).count() > MOST_SENT:
        return users.join(pooled, "profile_id")
    spark = users.sparkSession
    lots = max(users.select("user_id").count() // USERS_A_TASK, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return users.repartition(lots, "user_id").join(F.broadcast(pooled), "profile_id")


def listing_side(live: DataFrame, now_ms: int) -> DataFrame:
    """What scores need of a listing, worked out once: its length, norm, colors and decay."""
    decay = S.freshness_decay(S.age_days(now_ms, F.col("last_seen_ms")), S.half_life_days(F.col("source_id")))
    return live.withColumn("_known", H.known_length(F.col("length_inches"), F.col("length_class"))).select(
        "listing_id", "source_id", spread_key(F.col("brand"), F.col("source_id")).alias("spread"), "last_seen_ms",
        F.col("_known.length").alias("l_length"), F.col("_known.measured").alias("l_measured"), "length_basis", *_tags("attribute_vector", "l"), _swatches("colors").alias("l_colors"),
        decay.alias("decay"),
    )


def user_side(users: DataFrame) -> DataFrame:
    """What scores need of a user, worked out once."""
    boosted = F.coalesce("palette_boost_enabled", F.lit(True))
    return with_profile(users).select(
        "user_id", "profile_id", "height_inches", "heel_inches", "length_prefs", boosted.alias("boosted"),
        *_tags("style_tags", "u"), _swatches("palette").alias("u_colors"),
    )


def scored_pairs(users: DataFrame, live: DataFrame, pool: DataFrame, now_ms: int, taste: DataFrame | None = None,
                 vectors: DataFrame | None = None, include_unknown_length: bool = False) -> DataFrame:
    """User x pool rows with hem and score, after the user's own hem filter.

    Per-side work (parsing colors, vector norms, decay) is done before the join. ``taste`` (user_id, vector) and
    ``vectors`` (listing_id, vector) add the embedding part of the similarity where both exist.
    """
    pairs = _met(user_side(users), pool.select("profile_id", "listing_id").join(listing_side(live, now_ms), "listing_id")).drop("profile_id")
    return scored(pairs, taste, vectors, include_unknown_length)


def scored(pairs: DataFrame, taste: DataFrame | None = None, vectors: DataFrame | None = None, include_unknown_length: bool = False,
           keep: Sequence[str] = ()) -> DataFrame:
    """``scored_pairs`` of rows that hold both sides already; ``keep`` names further columns that stay."""
    pairs = pairs.withColumn("hem", H.hem_at(F.col("l_length"), F.col("l_measured"), F.col("height_inches"),
                                             F.col("heel_inches"), F.col("length_basis")))
    pairs = pairs.filter(H.hem_allowed(F.col("hem.position"), F.col("length_prefs"), include_unknown_length))
    dot = _tags_dot()
    blank = (F.col("u_norm") == 0) | (F.col("l_norm") == 0)
    similarity = F.when(blank, 0.5).otherwise((dot / (F.col("u_norm") * F.col("l_norm")) + 1) / 2)
    if taste is not None and vectors is not None:
        pairs = (
            pairs.join(taste.select("user_id", F.col("vector").alias("_u")), "user_id", "left")
            .join(vectors.select("listing_id", F.col("vector").alias("_v")), "listing_id", "left")
            .withColumn("_cos", F.when(F.col("_u").isNotNull() & F.col("_v").isNotNull(), pair_cosine("_u", "_v")))
            .drop("_u", "_v")
        )
        similarity = S.blend_similarity(similarity, F.when(F.col("_cos").isNotNull(), (F.col("_cos") + 1) / 2))
    hits = _palette_hits()
    n = F.size("l_colors")
    fraction = F.when((F.size("u_colors") > 0) & (n > 0), F.col("_hits") / n).otherwise(0.0)
    boost = F.when(F.col("boosted"), 1 + (PALETTE_BOOST_MAX - 1) * fraction).otherwise(1.0)
    return pairs.withColumns({"_hits": hits, "_sim": similarity}).withColumn(
        "score", F.round(S.base_score(F.col("_sim"), boost, F.col("decay")), SCORE_DIGITS)
    ).select("user_id", "listing_id", "source_id", "spread", "last_seen_ms", "hem", "score", "decay",
             (F.col("_hits") > 0).alias("palette_match"), *keep)


def rank_order() -> list[Column]:
    measured = F.when(F.col("hem.basis") == "measured_length", 0).otherwise(1)
    return [F.desc("score"), measured, F.desc("last_seen_ms"), F.asc("listing_id")]


def ranked(pairs: DataFrame, beside: Sequence[str] = ()) -> DataFrame:
    """Adds ``rank`` (from 0) per user: score, measured first, freshest. ``beside`` names columns that a user has one value of, by which pairs lie."""
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*beside, "user_id").orderBy(*rank_order())) - 1)


def apply_rerank(rows: DataFrame, external: DataFrame, head: int = RERANK_HEAD) -> DataFrame:
    """Merge an outside ranking (user_id, listing_id, place) over the first ``head`` ranks; the tail keeps its order.

    Named items of the head come first in the outside order, the others follow in their old order; head scores become a
    blend of the new place and the old score.

    A user's places come as one map, so ranked rows stay with their users; a row is as often there as its item is named.
    """
    inside = F.col("rank") < head
    named = external.filter(F.col("user_id").isNotNull() & F.col("listing_id").isNotNull()).groupBy("user_id", "listing_id").agg(F.collect_list(F.struct("place")).alias("_p"))
    places = named.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("listing_id", "_p"))).alias("_places"))
    rows = rows.join(places, "user_id", "left").withColumn("_p", F.col("_places")[F.col("listing_id")]).drop("_places")
    rows = rows.withColumn("_p", F.explode_outer("_p")).withColumn("place", F.col("_p.place")).drop("_p")
    by_user = Window.partitionBy("user_id")
    merged = rows.withColumn(
        "_new", F.row_number().over(by_user.orderBy(F.when(inside, 0).otherwise(1),
                                                    F.when(inside, F.coalesce("place", F.lit(2**30))), "rank")) - 1
    ).withColumn("_n", F.count(F.when(inside, 1)).over(by_user))
    blended = F.round(S.blend_rerank(S.rank_score(F.col("_new"), F.col("_n")), F.col("score")), SCORE_DIGITS)
    return merged.withColumn("score", F.when(inside, blended).otherwise(F.col("score"))).withColumn(
        "rank", F.col("_new")).drop("place", "_new", "_n")


def explain_line(rows: DataFrame, users: DataFrame, catalog: DataFrame) -> DataFrame:
    """Up to two reasons joined into one line: hem, palette, then shared style."""
    from garderobe.functions.reasons import reason_line
    return reason_line(rows, users, catalog)


def batch_feed(users: DataFrame, catalog: DataFrame, sources: DataFrame, now_ms: int, cap: int = CANDIDATE_CAP,
               external: DataFrame | None = None, taste: DataFrame | None = None,
               vectors: DataFrame | None = None, size_mode: str = "labels") -> DataFrame:
    """(user_id, position, listing_id, score, ...) for all users, brands and sources spread along each feed."""
    live = live_catalog(catalog, sources, now_ms)
    users = with_profile(users, size_mode)
    rows = ranked(scored_pairs(users, live, pools(users, live, cap, size_mode), now_ms, taste, vectors))
    if external is not None:
        rows = apply_rerank(rows, external)
    return interleave(rows, "user_id")


def feed_page(feed: DataFrame, offset: int, limit: int) -> DataFrame:
    return page(feed, "position", offset, limit)
