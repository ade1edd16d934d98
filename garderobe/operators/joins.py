"""Joins of the catalog with its attributes, images, vectors, runs and events, and the work lists built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garderobe.functions.hashing import destination_hash
from garderobe.operators.filters import active
from garderobe.operators.ranking import latest_by, newest

PROTECTED_MODELS = ("manual", "fixture")


def latest_extraction(extractions: DataFrame) -> DataFrame:
    """One extraction row per listing; older hashes of the same listing do not fan rows out."""
    return latest_by(extractions, ["listing_id"], F.struct("extracted_ms", "content_hash"))


def with_extraction(listings: DataFrame, extractions: DataFrame, how: str = "left") -> DataFrame:
    attrs = latest_extraction(extractions).withColumnRenamed("content_hash", "extraction_hash")
    return listings.join(attrs, "listing_id", how)


def with_vectors(listings: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """Active listings with the vector of their current content; vectors of outdated content drop out."""
    current = embeddings.filter(F.col("model") == model)
    live = listings.filter(active()).select("listing_id", "content_hash")
    return live.join(current, ["listing_id", "content_hash"])


def first_images(images: DataFrame) -> DataFrame:
    return images.groupBy("listing_id").agg(F.min_by("url", "position").alias("image_url"))


def length_targets(extractions: DataFrame, listings: DataFrame, images: DataFrame) -> DataFrame:
    """Extraction rows of active listings with their primary image."""
    live = listings.filter(active()).select("listing_id", "title", "description")
    primary = images.filter(F.col("position") == 0).select("listing_id", F.col("url").alias("image_url"))
    return extractions.join(live, "listing_id").join(primary, "listing_id")


def estimate_queue(targets: DataFrame) -> DataFrame:
    """Rows without inches that were never attempted and are not protected."""
    return targets.filter(
        F.col("length_inches").isNull() & F.col("length_basis").isNull() & ~F.col("model").isin(*PROTECTED_MODELS)
    )


def pending_extractions(listings: DataFrame, extractions: DataFrame, images: DataFrame, source_ids: DataFrame) -> DataFrame:
    """Active listings of the sources whose content has no extraction and that no one edited by hand."""
    manual = extractions.filter(F.col("model") == "manual").select("listing_id")
    todo = (
        listings.filter(active())
        .join(source_ids, "source_id", "left_semi")
        .join(extractions.select("content_hash"), "content_hash", "left_anti")
        .join(manual, "listing_id", "left_anti")
    )
    primary = images.filter(F.col("position") == 0).select("listing_id", F.col("url").alias("image_url"))
    return todo.join(primary, "listing_id", "left")


def missing_vectors(listings: DataFrame, images: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """Active listings with an image but no vector of their current content."""
    have = embeddings.filter(F.col("model") == model).select("content_hash")
    return (
        listings.filter(active())
        .join(have, "content_hash", "left_anti")
        .join(first_images(images), "listing_id")
        .select("listing_id", "content_hash", "image_url", "last_seen_ms")
    )


def drop_mock(extractions: DataFrame, listings: DataFrame, source_ids: DataFrame) -> DataFrame:
    """Extractions without the rule-based rows of the given sources, so those listings queue up again."""
    doomed = listings.join(source_ids, "source_id", "left_semi").select("listing_id")
    mock = extractions.filter(F.col("model") == "mock").join(doomed, "listing_id", "left_anti")
    return extractions.filter(F.col("model") != "mock").unionByName(mock)


def in_order(ids: DataFrame, listings: DataFrame) -> DataFrame:
    """Rows for (ordinal, listing_id) pairs in the order asked for; unknown ids drop out."""
    return ids.join(listings, "listing_id").orderBy("ordinal")


def hydrated(listings: DataFrame, images: DataFrame) -> DataFrame:
    """Listings with their images re-folded into ordered arrays (a listing has a bounded gallery)."""
    folded = images.groupBy("listing_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "url"))), lambda x: x["url"]).alias("image_urls")
    )
    bare = listings.drop("image_urls")
    return bare.join(folded, "listing_id", "left").withColumn(
        "image_urls", F.coalesce("image_urls", F.array().cast("array<string>"))
    )


def known_swipes(swipes: DataFrame, listings: DataFrame) -> DataFrame:
    return swipes.join(listings.select("listing_id"), "listing_id", "left_semi")


def clickouts(clicks: DataFrame, listings: DataFrame) -> DataFrame:
    """Clicks on known listings with their source and destination fingerprint; works on streams too."""
    target = listings.select(
        "listing_id", "source_id", destination_hash(F.col("affiliate_url"), F.col("source_url")).alias("destination_hash")
    )
    return clicks.join(target, "listing_id")


def swiped_vectors(swipes: DataFrame, vectors: DataFrame) -> DataFrame:
    return swipes.join(vectors, "listing_id")


def already_listed(urls: DataFrame, listings: DataFrame) -> DataFrame:
    """Adds ``in_catalog`` and the listing found by its URL; of several with one URL, the least."""
    known = listings.groupBy(F.col("source_url").alias("url")).agg(F.min("listing_id").alias("found_id"))
    return urls.join(known, "url", "left").withColumn("in_catalog", F.col("found_id").isNotNull())


def ok_runs(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """Last successful start per enabled source."""
    live = sources.filter("enabled").select("source_id")
    return runs.filter(F.col("status") == "ok").join(live, "source_id", "left_semi").groupBy("source_id").agg(
        F.max("started_ms").alias("last_ok_ms")
    )


def newest_queue(df: DataFrame, limit: int) -> DataFrame:
    return df.orderBy(*newest()).limit(limit)
