"""Error groups: fingerprints, counts, hour buckets, retention and the spike flag."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from garderobe.functions.hashing import error_fingerprint

HOUR_MS = 3_600_000
MAX_GROUPS = 500
MAX_AGE_MS = 30 * 24 * HOUR_MS
SPIKE_THRESHOLD = 20


def fingerprinted(events: DataFrame) -> DataFrame:
    text = F.when(F.coalesce("message", F.lit("")) == "", "unknown error").otherwise(F.col("message"))
    return events.withColumns({
        "stack_hash": error_fingerprint(F.col("route"), text, F.col("stack")),
        "message": text,
        "stack": F.when(F.col("stack") != "", F.col("stack")),
        "hour_bucket": F.floor(F.col("ts_ms") / HOUR_MS),
    })


def error_groups(events: DataFrame) -> DataFrame:
    """One row per fingerprint: count, first and last seen, latest message, count in the latest hour bucket.

    Counts are first combined per (fingerprint, hour), so a fingerprint holding most rows is spread over its hours.
    """
    hourly = fingerprinted(events).groupBy("stack_hash", "hour_bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("ts_ms").alias("first_ms"),
        F.max("ts_ms").alias("last_ms"),
        F.max_by(F.struct("route", "message", "stack"), F.struct("ts_ms", "error_id")).alias("latest"),
    )
    return hourly.groupBy("stack_hash").agg(
        F.max_by("latest.route", "hour_bucket").alias("route"),
        F.max_by("latest.message", "hour_bucket").alias("message"),
        F.max_by("latest.stack", "hour_bucket").alias("stack"),
        F.sum("n").alias("count"),
        F.min("first_ms").alias("first_seen_ms"),
        F.max("last_ms").alias("last_seen_ms"),
        F.max("hour_bucket").alias("hour_bucket"),
        F.max_by("n", "hour_bucket").alias("hour_count"),
    )


def error_stats(groups: DataFrame, now_ms: int) -> DataFrame:
    """Number of groups and occurrences in the current and previous hour bucket."""
    bucket = now_ms // HOUR_MS
    return groups.agg(
        F.count(F.lit(1)).alias("groups"),
        F.coalesce(F.sum(F.when(F.col("hour_bucket") >= bucket - 1, F.col("hour_count"))), F.lit(0)).alias("last_hour"),
    ).withColumn("spike", F.col("last_hour") >= SPIKE_THRESHOLD)


def retained(groups: DataFrame, now_ms: int, max_groups: int = MAX_GROUPS, max_age_ms: int = MAX_AGE_MS) -> DataFrame:
    """Groups young enough and among the most recently seen (the table's retention rule)."""
    return groups.filter(F.col("last_seen_ms") >= now_ms - max_age_ms).orderBy(
        F.desc("last_seen_ms"), F.asc("stack_hash")
    ).limit(max_groups)


def recent_groups(groups: DataFrame, limit: int = 50) -> DataFrame:
    return groups.orderBy(F.desc("last_seen_ms"), F.asc("stack_hash")).limit(limit)


def hourly_spikes(events: DataFrame, threshold: int = SPIKE_THRESHOLD) -> DataFrame:
    """Two-hour windows sliding by one hour whose error count reaches the threshold."""
    counts = events.groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= threshold).select(
        F.unix_millis("w.start").alias("start_ms"), F.unix_millis("w.end").alias("end_ms"), "n"
    )
