"""Brand clean-up and audience purge, as dry-run reports and as next snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garderobe.functions.audience import child_reason
from garderobe.functions.brands import resolved_brand
from garderobe.operators.filters import active
from garderobe.operators.ranking import top_n
from garderobe.session import stage

SAMPLES = 5


def rebranded(listings: DataFrame, stores: DataFrame) -> DataFrame:
    """Listings of configured stores with ``brand_after``; other sources keep their brand. Content hashes do not change."""
    s = stores.select("source_id", "display_name", "brand_name", "brand_mode", "known_brands", F.lit(True).alias("_store"))
    rows = listings.join(s, "source_id", "left")
    after = resolved_brand(F.col("brand"), F.col("display_name"), F.col("brand_name"), F.col("brand_mode"), F.col("known_brands"))
    return rows.withColumn("brand_after", F.when(F.col("_store"), after).otherwise(F.col("brand"))).drop(
        "display_name", "brand_name", "brand_mode", "known_brands", "_store")


def brand_report(listings: DataFrame, stores: DataFrame) -> DataFrame:
    """(source_id, before, after, n) for every rewrite a run would make."""
    rows = rebranded(listings, stores).filter(~F.col("brand").eqNullSafe(F.col("brand_after")))
    return rows.groupBy("source_id", F.col("brand").alias("before"), F.col("brand_after").alias("after")).agg(
        F.count(F.lit(1)).alias("n"))


def apply_brands(listings: DataFrame, stores: DataFrame) -> DataFrame:
    return rebranded(listings, stores).withColumn("brand", F.col("brand_after")).drop("brand_after")


def orphans(cache: DataFrame, listings: DataFrame) -> DataFrame:
    """Cache rows whose content hash no listing has (history, not damage: compare before and after)."""
    return cache.join(listings.select("content_hash"), "content_hash", "left_anti").agg(F.count(F.lit(1)).alias("orphans"))


def flagged_children(listings: DataFrame) -> DataFrame:
    reason = child_reason(F.col("title"), F.col("size_labels"))
    return listings.filter(active()).withColumn("reason", reason).filter(F.col("reason").isNotNull())


def kept_flags(flags: DataFrame, extractions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(flags that stand, flags cleared by an adult verdict)."""
    adult = extractions.filter(F.col("audience") == "adult").select("listing_id")
    flags = stage(flags, "child-flags")  # read by both
    return flags.join(adult, "listing_id", "left_anti"), flags.join(adult, "listing_id", "left_semi")


def flag_report(flags: DataFrame) -> DataFrame:
    """Per source: number of flags and up to five sample titles."""
    counts = flags.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    line = F.concat(F.col("title"), F.lit(" ["), F.col("reason"), F.lit("]"))
    few = top_n(flags.select("source_id", "listing_id", line.alias("line")), ["source_id"], [F.asc("listing_id")], SAMPLES)
    samples = few.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))),
                                                       lambda x: x["line"]).alias("samples"))
    return counts.join(samples, "source_id")


def apply_purge(listings: DataFrame, extractions: DataFrame, flags: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """(listings with flagged rows removed, extractions with their verdict)."""
    marks = flags.select("listing_id", F.lit(True).alias("_hit"))
    gone = listings.join(marks, "listing_id", "left").withColumn(
        "removed_ms", F.when(F.col("_hit") & F.col("removed_ms").isNull(), F.lit(now_ms)).otherwise(F.col("removed_ms"))).drop("_hit")
    told = extractions.join(marks, "listing_id", "left").withColumn(
        "audience", F.when(F.col("_hit"), F.lit("child")).otherwise(F.col("audience"))).drop("_hit")
    return gone, told


def vision_suspects(listings: DataFrame, extractions: DataFrame, images: DataFrame, source_ids: DataFrame) -> DataFrame:
    """Active listings of sources with a children's line that have no verdict yet and that the rules do not flag."""
    judged = extractions.filter(F.col("audience").isNotNull()).select("listing_id")
    rows = listings.filter(active()).join(source_ids, "source_id", "left_semi").join(judged, "listing_id", "left_anti")
    rows = rows.filter(child_reason(F.col("title"), F.col("size_labels")).isNull())
    primary = images.filter(F.col("position") == 0).select("listing_id", F.col("url").alias("image_url"))
    return rows.join(primary, "listing_id", "left")
