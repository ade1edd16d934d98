"""Catalog snapshots: validation, content-hash upsert, removals, staleness, images and run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garderobe.functions.hashing import content_hash
from garderobe.functions.sizes import normalized_sizes

HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS

CONTENT = ["source_url", "affiliate_url", "title", "description", "brand", "price_cents", "currency", "condition",
           "is_vintage", "era", "size_labels", "image_urls"]


def validity() -> Column:
    """NULL for a valid raw listing, else the first reason it is rejected."""
    return (
        F.when(F.coalesce(F.trim("source_id"), F.lit("")) == "", "source_id")
        .when(F.coalesce(F.trim("source_listing_id"), F.lit("")) == "", "source_listing_id")
        .when(~F.coalesce(F.col("source_url"), F.lit("")).rlike(r"(?i)^https?://[^/\s]+"), "source_url")
        .when(F.coalesce(F.trim("title"), F.lit("")) == "", "title")
        .when(F.col("price_cents").isNull() | (F.col("price_cents") < 0), "price_cents")
        .when(F.length(F.coalesce("currency", F.lit(""))) != 3, "currency")
        .when(F.col("seen_ms").isNull(), "seen_ms")
    )


def split_valid(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejects with ``reason``)."""
    marked = batch.withColumn("reason", validity())
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())


def first_of_each(batch: DataFrame, order: str = "ordinal") -> DataFrame:
    """The first row per (source, source listing) in source order."""
    keys = ["source_id", "source_listing_id"]
    rest = [c for c in batch.columns if c not in keys]
    return batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, "_r.*")


def hashed(batch: DataFrame) -> DataFrame:
    return batch.withColumns({
        "listing_id": F.concat_ws(":", "source_id", "source_listing_id"),
        "content_hash": content_hash(F.col("title"), F.col("description"), F.col("price_cents"), F.col("image_urls"),
                                     F.col("size_labels")),
    })


def classified(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    """Full outer join of snapshot (``s``) and batch (``b``) on the listing id with ``change`` per row."""
    joined = snapshot.alias("s").join(batch.alias("b"), F.col("s.listing_id") == F.col("b.listing_id"), "full_outer")
    change = (
        F.when(F.col("b.listing_id").isNull(), "absent")
        .when(F.col("s.listing_id").isNull(), "new")
        .when(F.col("s.content_hash") == F.col("b.content_hash"), "unchanged")
        .otherwise("updated")
    )
    return joined.withColumn("change", change)


def next_snapshot(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    """The snapshot after the batch, with ``change`` for statistics.

    New and changed rows take all content from the batch. An unchanged row only moves its last sighting, takes the new
    availability and comes back if it was removed; sizes narrowed by verification stay. First sightings are kept.
    The caller writes the result to a new path; only sources named in the batch need rewriting.
    """
    rows = classified(snapshot, batch)
    fresh = F.col("change").isin("new", "updated")
    seen = F.col("change") != "absent"
    out = {
        "listing_id": F.coalesce("b.listing_id", "s.listing_id"),
        "source_id": F.coalesce("b.source_id", "s.source_id"),
        "source_listing_id": F.coalesce("b.source_listing_id", "s.source_listing_id"),
        **{c: F.when(fresh, F.col(f"b.{c}")).otherwise(F.col(f"s.{c}")) for c in CONTENT},
        "size_normalized": F.when(fresh, normalized_sizes(F.col("b.size_labels"))).otherwise(F.col("s.size_normalized")),
        "availability": F.when(seen, F.coalesce("b.availability", F.create_map().cast("map<string,boolean>")))
        .otherwise(F.col("s.availability")),
        "content_hash": F.coalesce("b.content_hash", "s.content_hash"),
        "first_seen_ms": F.coalesce("s.first_seen_ms", "b.seen_ms"),
        "last_seen_ms": F.coalesce("b.seen_ms", "s.last_seen_ms"),
        "removed_ms": F.when(~seen, F.col("s.removed_ms")),
        "verified_ms": F.col("s.verified_ms"),
    }
    return rows.select(*[c.alias(n) for n, c in out.items()], "change")


def apply_removals(snapshot: DataFrame, gone: DataFrame, now_ms: int) -> DataFrame:
    """Soft delete the (source_id, source_listing_id) pairs a source reports as gone."""
    marks = gone.select("source_id", "source_listing_id").distinct().withColumn("_gone", F.lit(True))
    return snapshot.join(marks, ["source_id", "source_listing_id"], "left").withColumn(
        "removed_ms", F.when(F.col("_gone"), F.lit(now_ms)).otherwise(F.col("removed_ms"))
    ).drop("_gone")


def cron_interval_ms(cron: Column) -> Column:
    """Cadence of a cron line: hourly steps, minute steps, a day otherwise, a week when tied to a day of month."""
    fields = F.split(F.trim(cron), r"\s+")

    def step(at: int) -> Column:
        digits = F.regexp_extract(F.get(fields, F.lit(at)), r"^\*/(\d+)$", 1)
        return F.nullif(F.nullif(digits, F.lit("")), F.lit("0")).cast("long")

    return (
        F.when(F.size(fields) < 5, F.lit(DAY_MS))
        .when(F.get(fields, F.lit(2)) != "*", F.lit(7 * DAY_MS))
        .when(step(1).isNotNull(), step(1) * F.lit(HOUR_MS).cast("long"))
        .when(step(0).isNotNull() & (F.get(fields, F.lit(1)) == "*"), step(0) * F.lit(60_000).cast("long"))
        .otherwise(F.lit(DAY_MS))
        .cast("long")
    )


def prune_stale(snapshot: DataFrame, sources: DataFrame, now_ms: int) -> DataFrame:
    """Soft delete active rows unseen for more than twice their source's cadence; adds ``pruned``."""
    cutoff = sources.select("source_id", (F.lit(now_ms) - 2 * cron_interval_ms(F.col("cadence_cron"))).alias("_cutoff"))
    rows = snapshot.join(cutoff, "source_id", "left")
    stale = F.coalesce(F.col("removed_ms").isNull() & (F.col("last_seen_ms") < F.col("_cutoff")), F.lit(False))
    return rows.withColumn("pruned", stale).withColumn(
        "removed_ms", F.when(F.col("pruned"), F.lit(now_ms)).otherwise(F.col("removed_ms"))
    ).drop("_cutoff")


def replace_images(images: DataFrame, changed: DataFrame) -> DataFrame:
    """Image rows after new and changed listings (listing_id, image_urls) replaced their galleries."""
    fresh = changed.select("listing_id", F.posexplode("image_urls").alias("position", "url"))
    kept = images.join(changed.select("listing_id"), "listing_id", "left_anti")
    return kept.select("listing_id", "position", "url").unionByName(fresh)


def run_stats(snapshot: DataFrame) -> DataFrame:
    return snapshot.filter(F.col("change") != "absent").groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def total_stats(runs: DataFrame) -> DataFrame:
    """Counters of a run log rolled up; ok when any run was."""
    def stat(name: str) -> Column:
        return F.coalesce(F.sum(F.get_json_object("stats", f"$.{name}").cast("long")), F.lit(0)).alias(name)

    return runs.agg(stat("fetched"), stat("new"), stat("errors"), F.bool_or(F.col("status") == "ok").alias("ok"))


def ingest_snapshot(snapshot: DataFrame, batch: DataFrame, sources: DataFrame, now_ms: int,
                    gone: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(next snapshot with ``change`` and ``pruned``, rejects)."""
    valid, rejects = split_valid(batch)
    after = next_snapshot(snapshot, hashed(first_of_each(valid)))
    if gone is not None:
        after = apply_removals(after, gone, now_ms)
    return prune_stale(after, sources, now_ms), rejects


def upsert_vectors(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Vector table keyed by (content_hash, model), the later row winning."""
    keys = ["content_hash", "model"]
    rest = [c for c in existing.columns if c not in keys]
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    latest = F.max_by(F.struct(*rest), F.struct("_new", "embedded_ms"))
    return both.groupBy(*keys).agg(latest.alias("_r")).select(*keys, "_r.*")
