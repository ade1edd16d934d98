"""User profiles and alerts as latest state over change feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def patched_profiles(users: DataFrame, patches: DataFrame, fields: list[str]) -> DataFrame:
    """Users after an ordered feed of partial patches.

    A patch has (user_id, seq, names array<string>, the fields). A named field is written even when NULL; the last patch
    naming a field wins. Each field is an aggregate over the feed, so a user's patches are never gathered.
    """
    last = {
        f: F.max_by(F.struct(F.col(f).alias("v")), F.when(F.array_contains("names", f), F.col("seq"))).alias(f"_{f}")
        for f in fields
    }
    named = {f: F.bool_or(F.array_contains("names", f)).alias(f"_has_{f}") for f in fields}
    folded = patches.groupBy("user_id").agg(*last.values(), *named.values())
    rows = users.join(folded, "user_id", "left")
    return rows.select(*[
        F.when(F.coalesce(F.col(f"_has_{c}"), F.lit(False)), F.col(f"_{c}.v")).otherwise(F.col(c)).alias(c)
        if c in fields else F.col(c) for c in users.columns
    ])


def replaced_brand_sizes(current: DataFrame, puts: DataFrame) -> DataFrame:
    """Brand sizes after users replaced their whole set; within one set the last entry of a brand wins.

    ``puts`` has (user_id, seq, ord, brand, size_label); rows of a user's latest ``seq`` form the new set.
    """
    latest = puts.groupBy("user_id").agg(F.max("seq").alias("seq"))
    fresh = puts.join(latest, ["user_id", "seq"]).filter(F.col("brand").isNotNull()).groupBy("user_id", "brand").agg(
        F.max_by("size_label", "ord").alias("size_label"))
    kept = current.join(latest, "user_id", "left_anti")
    return kept.select("user_id", "brand", "size_label").unionByName(fresh)


def with_brand_sizes(users: DataFrame, brand_sizes: DataFrame) -> DataFrame:
    """Profiles with their brand sizes as an array (a user has a bounded number of brands)."""
    folded = brand_sizes.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("brand", "size_label"))).alias("brand_sizes"))
    empty = F.array().cast("array<struct<brand:string,size_label:string>>")
    return users.join(folded, "user_id", "left").withColumn("brand_sizes", F.coalesce("brand_sizes", empty))


def alert_state(toggles: DataFrame) -> DataFrame:
    """Alerts after toggles: the last toggle decides ``enabled``, the last given search stays.

    A toggle without a listing never meets another one, so each is its own alert.
    """
    keyed = toggles.withColumn("_own", F.when(F.col("listing_id").isNull(), F.col("toggle_id")))
    order = F.struct("created_ms", "toggle_id")
    return keyed.groupBy("user_id", "listing_id", "kind", "_own").agg(
        F.max_by("enabled", order).alias("enabled"),
        F.max_by("search", F.when(F.col("search").isNotNull(), order)).alias("search"),
        F.min("created_ms").alias("created_ms"),
        F.max("created_ms").alias("updated_ms"),
    ).drop("_own")


def latest_alert(alerts: DataFrame) -> DataFrame:
    """The most recently updated alert per (user, kind)."""
    order = F.struct("updated_ms", "created_ms", F.coalesce("listing_id", F.lit("")))
    return alerts.groupBy("user_id", "kind").agg(F.max_by(F.struct("listing_id", "enabled", "updated_ms"), order).alias("a")).select(
        "user_id", "kind", "a.*")
