"""Catalog and ingestion health rollups, one grouped pass per table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garderobe.functions.money import rounded
from garderobe.operators.filters import HOUR_MS, active
from garderobe.operators.joins import ok_runs, with_vectors
from garderobe.operators.ranking import latest_by


def latest_runs(runs: DataFrame) -> DataFrame:
    return latest_by(runs, ["source_id"], F.struct("started_ms", "run_id"))


def source_health(sources: DataFrame, listings: DataFrame, runs: DataFrame, now_ms: int) -> DataFrame:
    """Per source: totals, freshness, error runs and the latest run. A row exactly 48 h old is both fresh and stale."""
    live, seen = active(), F.col("last_seen_ms")
    counts = listings.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(live).alias("active"),
        F.count_if(live & (seen >= now_ms - 24 * HOUR_MS)).alias("fresh_24h"),
        F.count_if(live & (seen >= now_ms - 48 * HOUR_MS)).alias("fresh_48h"),
        F.count_if(live & (seen <= now_ms - 48 * HOUR_MS)).alias("stale_48h"),
    )
    errors = runs.groupBy("source_id").agg(
        F.count_if(F.col("status") == "error").alias("error_runs"),
        F.max_by(F.struct("run_id", "started_ms", "status", "stats"), F.struct("started_ms", "run_id")).alias("last"),
    )
    numbers = ["total", "active", "fresh_24h", "fresh_48h", "stale_48h", "error_runs"]
    return (
        sources.join(counts, "source_id", "left").join(errors, "source_id", "left")
        .select(
            "source_id", "kind", "display_name", "enabled", "cadence_cron",
            *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers],
            (F.coalesce("total", F.lit(0)) - F.coalesce("active", F.lit(0))).alias("removed"),
            F.col("last.run_id").alias("last_run_id"), F.col("last.started_ms").alias("last_started_ms"),
            F.col("last.status").alias("last_status"),
            F.coalesce(F.get_json_object("last.stats", "$.fetched").cast("long"), F.lit(0)).alias("last_fetched"),
        )
    )


def percent(part, whole):
    return F.when(whole > 0, rounded(100.0 * part / whole, 1)).otherwise(0.0)


def overview(listings: DataFrame, extractions: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Catalog totals and attribute coverage over active listings, in one row.

    Coverage flags are folded per listing before counting, so distinct counts need no set per group.
    """
    totals = listings.agg(F.count(F.lit(1)).alias("total"), F.count_if(active()).alias("active"))
    live = listings.filter(active()).select("listing_id")
    flags = extractions.join(live, "listing_id", "left_semi").groupBy("listing_id").agg(
        F.bool_or(F.col("length_class").isNotNull()).alias("c"),
        F.bool_or(F.col("length_inches").isNotNull()).alias("i"),
        F.bool_or(F.size("colors") > 0).alias("k"),
    )
    cover = flags.agg(F.count(F.lit(1)).alias("extracted"), F.count_if("c").alias("c"), F.count_if("i").alias("i"),
                      F.count_if("k").alias("k"))
    vectors = embeddings.agg(F.count(F.lit(1)).alias("vector_rows"))
    embedded = embeddings.select("listing_id").join(live, "listing_id", "left_semi").agg(
        F.count_distinct("listing_id").alias("embedded_listings")
    )
    one = totals.withColumn("_one", F.lit(1))
    for part in (cover, vectors, embedded):
        one = one.join(part.withColumn("_one", F.lit(1)), "_one")  # single-row frames
    return one.select(
        "total", "active", "vector_rows", "embedded_listings", "extracted",
        percent(F.col("c"), F.col("active")).alias("length_class_pct"),
        percent(F.col("i"), F.col("active")).alias("length_inches_pct"),
        percent(F.col("k"), F.col("active")).alias("colors_pct"),
    )


def length_coverage(listings: DataFrame, extractions: DataFrame) -> DataFrame:
    rows = listings.filter(active()).select("listing_id").join(extractions, "listing_id", "left")
    inches, basis = F.col("length_inches").isNotNull(), F.col("length_basis")
    anchor = F.col("length_anchor") if "length_anchor" in extractions.columns else F.lit(None).cast("string")
    return rows.agg(
        F.count(F.lit(1)).alias("live"),
        F.count_if(inches).alias("with_inches"),
        F.count_if(inches & (basis.isNull() | (basis == "stated"))).alias("stated"),
        F.count_if(inches & (basis == "image_estimate")).alias("image_estimated"),
        F.count_if(inches & (basis == "image_estimate") & (anchor == "stated_model_height")).alias("anchored"),
        F.count_if(basis == "not_estimable").alias("not_estimable"),
        F.count_if(F.col("length_class").isNotNull()).alias("with_class"),
    )


def clickout_stats(clickouts: DataFrame, now_ms: int) -> DataFrame:
    """Totals by source with a grand total row (source NULL)."""
    recent = F.count_if(F.col("created_ms") >= now_ms - 24 * HOUR_MS).alias("last_24h")
    return clickouts.rollup("source_id").agg(F.count(F.lit(1)).alias("total"), recent)


def embedding_stats(listings: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    return with_vectors(listings, embeddings, model).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.max("embedded_ms"), F.lit(0)).alias("last_embedded_ms")
    )


def stalest_source(runs: DataFrame, sources: DataFrame, now_ms: int, stale_hours: int = 30) -> DataFrame:
    """The enabled source whose last success is oldest, and whether that raises an alert."""
    worst = ok_runs(runs, sources).agg(
        F.min_by("source_id", F.struct("last_ok_ms", "source_id")).alias("source_id"),
        F.min("last_ok_ms").alias("last_ok_ms"),
    )
    age = F.lit(now_ms) - F.col("last_ok_ms")
    return worst.filter(F.col("source_id").isNotNull()).select(
        "source_id", "last_ok_ms", F.floor(age / HOUR_MS + 0.5).alias("age_hours"),
        (age > stale_hours * HOUR_MS).alias("alert"),
    )
