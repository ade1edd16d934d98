"""Learned taste: tag vectors from ordered swipes, style embeddings from liked items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garderobe.functions.vectors import l2_normalize
from garderobe.operators.folds import clamped_fold, mean_vector, weighted_vector_sum
from garderobe.operators.ranking import top_n
from garderobe.values import SAVE_VECTOR_WEIGHT, STYLE_SWIPE_LIMIT, SWIPE_PRESETS


def verdict_rate(preset: str) -> Column:
    rates = SWIPE_PRESETS[preset]["rates"]
    return F.expr("case verdict " + " ".join(f"when '{v}' then {r}D" for v, r in rates.items()) + " end")


def tag_steps(swipes: DataFrame, vectors: DataFrame, preset: str) -> DataFrame:
    """(user_id, tag, created_ms, swipe_id, delta) for every tag of every swiped known listing."""
    rates = swipes.withColumn("_rate", verdict_rate(preset)).filter(F.col("_rate").isNotNull())
    return rates.join(vectors.select("listing_id", "attribute_vector"), "listing_id").select(
        "user_id", "created_ms", "swipe_id", "_rate", F.explode("attribute_vector").alias("tag", "_w")
    ).select("user_id", "tag", "created_ms", "swipe_id", (F.col("_rate") * F.col("_w")).alias("delta"))


def style_tags(swipes: DataFrame, vectors: DataFrame, preset: str = "live", current: DataFrame | None = None) -> DataFrame:
    """(user_id, tag, value) after all swipes, small weights pruned at the end.

    ``current`` (user_id, tag, value) is the vector to continue from.
    """
    rule = SWIPE_PRESETS[preset]
    folded = clamped_fold(tag_steps(swipes, vectors, preset), ["user_id", "tag"], ["created_ms", "swipe_id"], "delta",
                          -rule["clamp"], rule["clamp"], current)
    return folded.filter(F.round(F.abs("value"), 9) >= rule["prune"])


def as_map(tags: DataFrame) -> DataFrame:
    return tags.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("tag", "value"))).alias("style_tags"))


def positives(swipes: DataFrame, limit: int = STYLE_SWIPE_LIMIT) -> DataFrame:
    """Each user's latest likes and saves."""
    liked = swipes.filter(F.col("verdict").isin("like", "save"))
    return top_n(liked, ["user_id"], [F.desc("created_ms"), F.desc("swipe_id")], limit).drop("rank")


def style_embeddings(swipes: DataFrame, vectors: DataFrame, limit: int = STYLE_SWIPE_LIMIT) -> DataFrame:
    """(user_id, vector): weighted mean of the latest positives' vectors, a save counting more than a like."""
    rows = positives(swipes, limit).join(vectors.select("listing_id", "vector"), "listing_id")
    weight = F.when(F.col("verdict") == "save", SAVE_VECTOR_WEIGHT).otherwise(1.0)
    return mean_vector(rows, ["user_id"], "vector", weight)


def dense_style_update(current: DataFrame, swipes: DataFrame, vectors: DataFrame, preset: str = "package") -> DataFrame:
    """(user_id, vector): current unit vector plus rate-weighted item vectors, scaled to unit length once."""
    moved = swipes.withColumn("_w", verdict_rate(preset)).filter(F.col("_w").isNotNull())
    steps = moved.join(vectors.select("listing_id", "vector"), "listing_id").select("user_id", "vector", "_w")
    start = current.select("user_id", F.col("vector").cast("array<float>").alias("vector"), F.lit(1.0).alias("_w"))
    total = weighted_vector_sum(steps.withColumn("vector", F.col("vector").cast("array<float>")).unionByName(start),
                                ["user_id"], "vector", F.col("_w"))
    return total.select("user_id", l2_normalize(F.col("vector")).alias("vector"))
