"""Availability re-checks: work lists, observed outcomes and the snapshot they lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garderobe.functions.sizes import in_stock_labels, normalized_sizes
from garderobe.operators.filters import active, verifiable_source


def oldest_verified(listings: DataFrame, limit: int) -> DataFrame:
    """Active verifiable listings, never verified ones first."""
    return listings.filter(active() & verifiable_source()).orderBy(
        F.coalesce("verified_ms", F.lit(0)), "last_seen_ms", "listing_id"
    ).limit(limit)


def enqueue(requests: DataFrame, listings: DataFrame) -> DataFrame:
    """One queue row per listing, the earliest request; unknown, removed and unverifiable listings are ignored."""
    eligible = listings.filter(active() & verifiable_source()).select("listing_id")
    return (
        requests.join(eligible, "listing_id", "left_semi").groupBy("listing_id")
        .agg(F.min_by("reason", F.struct("enqueued_ms", "reason")).alias("reason"),
             F.min("enqueued_ms").alias("enqueued_ms"))
    )


def queue_head(queue: DataFrame, limit: int) -> DataFrame:
    return queue.orderBy("enqueued_ms", "listing_id").limit(limit)


def dequeue(queue: DataFrame, processed: DataFrame) -> DataFrame:
    return queue.join(processed.select("listing_id"), "listing_id", "left_anti")


def same_map(a: Column, b: Column) -> Column:
    return F.array_sort(F.map_entries(a)) == F.array_sort(F.map_entries(b))


def outcomes(listings: DataFrame, observations: DataFrame) -> DataFrame:
    """Outcome per observed listing.

    ``observations`` has (listing_id, http_status, seen map<string,boolean>, explicit_stock). A page that is gone, or
    whose every size is sold, leads to removal; a page without any stock signal never does.
    """
    rows = observations.join(listings.select("listing_id", "availability", "removed_ms"), "listing_id", "left")
    sizes = F.size(F.coalesce(F.col("seen"), F.create_map().cast("map<string,boolean>")))
    any_in = F.exists(F.map_values("seen"), lambda v: v)
    gone = F.col("http_status").isin(404, 410)
    outcome = (
        F.when(F.col("availability").isNull(), "unsupported")
        .when(F.col("removed_ms").isNotNull(), "ok")
        .when(gone, "gone")
        .when(~F.col("http_status").between(200, 299), "inconclusive")
        .when((sizes > 0) & ~any_in, "sold_out")
        .when((sizes > 0) & ~same_map(F.col("seen"), F.col("availability")), "availability_updated")
        .when(sizes > 0, "ok")
        .when(F.col("explicit_stock") == "out_of_stock", "sold_out")
        .when(F.col("explicit_stock") == "in_stock", "ok")
        .otherwise("inconclusive")
    )
    return rows.select("listing_id", outcome.alias("outcome"), "seen", F.col("removed_ms").isNotNull().alias("_was_removed"))


def apply_outcomes(listings: DataFrame, decided: DataFrame, now_ms: int) -> DataFrame:
    """Next snapshot: removals, replaced availability with sizes from in-stock labels, verification times."""
    rows = listings.join(decided.withColumnRenamed("seen", "_seen"), "listing_id", "left")
    checked = F.col("outcome").isin("gone", "sold_out", "availability_updated", "ok") & ~F.col("_was_removed")
    removed = F.col("outcome").isin("gone", "sold_out")
    replaced = (F.col("outcome").isin("availability_updated", "ok")) & ~F.col("_was_removed") & (F.size("_seen") > 0)
    return rows.withColumns({
        "removed_ms": F.when(removed, F.lit(now_ms)).otherwise(F.col("removed_ms")),
        "verified_ms": F.when(checked, F.lit(now_ms)).otherwise(F.col("verified_ms")),
        "size_normalized": F.when(replaced, normalized_sizes(in_stock_labels(F.col("_seen"))))
        .otherwise(F.col("size_normalized")),
        "availability": F.when(replaced, F.col("_seen")).otherwise(F.col("availability")),
    }).drop("_seen", "outcome", "_was_removed")


def outcome_counts(decided: DataFrame) -> DataFrame:
    return decided.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def stock_signal(offers: DataFrame, key: str = "page_id") -> DataFrame:
    """Explicit stock per page: any in stock, all out of stock, or NULL when no offer says."""
    flag = F.bool_or("available")
    return offers.groupBy(key).agg(F.when(flag, "in_stock").when(~flag, "out_of_stock").alias("stock"))
