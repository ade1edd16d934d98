"""Saved items with hem, score and the possibly-sold flag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garderobe.functions import hem as H
from garderobe.functions import scoring as S
from garderobe.operators.filters import possibly_sold


def saved(swipes: DataFrame) -> DataFrame:
    """(user_id, listing_id, saved_ms): one row per saved listing, at its latest save."""
    return swipes.filter(F.col("verdict") == "save").groupBy("user_id", "listing_id").agg(
        F.max("created_ms").alias("saved_ms"))


def save_state(actions: DataFrame) -> DataFrame:
    """Listings saved and not taken off since: the latest action per (user, listing) decides.

    ``actions`` has (user_id, listing_id, action in save/unsave, created_ms, action_id); the first save of the current
    streak keeps its time.
    """
    last_off = actions.filter(F.col("action") == "unsave").groupBy("user_id", "listing_id").agg(
        F.max(F.struct("created_ms", "action_id")).alias("_off"))
    kept = actions.filter(F.col("action") == "save").join(last_off, ["user_id", "listing_id"], "left").filter(
        F.col("_off").isNull() | (F.struct("created_ms", "action_id") > F.col("_off")))
    return kept.groupBy("user_id", "listing_id").agg(F.min("created_ms").alias("saved_ms"))


def is_saved(pairs: DataFrame, saved_: DataFrame) -> DataFrame:
    flags = saved_.select("user_id", "listing_id", F.lit(True).alias("saved"))
    return pairs.join(flags, ["user_id", "listing_id"], "left").withColumn("saved", F.coalesce("saved", F.lit(False)))


def rack(users: DataFrame, swipes: DataFrame, catalog: DataFrame, sources: DataFrame, now_ms: int) -> DataFrame:
    flagged = possibly_sold(catalog, sources, now_ms).select(
        "listing_id", "source_id", "last_seen_ms", "length_inches", "length_class", "length_basis", "attribute_vector",
        "colors", "possibly_sold")
    profile = users.select("user_id", "height_inches", "heel_inches", "style_tags", "palette",
                           F.coalesce("palette_boost_enabled", F.lit(True)).alias("boosted"))
    rows = saved(swipes).join(flagged, "listing_id").join(profile, "user_id")
    boost = F.when(F.col("boosted"), S.palette_boost(F.col("palette"), F.col("colors"))).otherwise(1.0)
    decay = S.freshness_decay(S.age_days(now_ms, F.col("last_seen_ms")), S.half_life_days(F.col("source_id")))
    sim = S.attribute_similarity(F.col("style_tags"), F.col("attribute_vector"))
    return rows.withColumns({
        "hem": H.hem(F.col("length_inches"), F.col("length_class"), F.col("height_inches"), F.col("heel_inches")),
        "score": F.round(S.base_score(sim, boost, decay), 9),
        "palette_match": S.palette_match(F.col("palette"), F.col("colors")),
    }).select("user_id", "listing_id", "saved_ms", "hem", "score", "palette_match", "possibly_sold")
