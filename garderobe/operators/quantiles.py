"""Exact order statistics that never gather a whole group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 4096


def exact_median(df: DataFrame, keys: list[str], value: str, out: str = "median", bucket: int = BUCKET, count: str | None = None) -> DataFrame:
    """Median of an integer column per key, an even count giving the midpoint rounded half up.

    Values are counted first (map-side combined), the counts are summed into value buckets, and only the buckets that
    hold the middle ranks are looked at value by value. A task sees at most ``range / bucket`` bucket rows or
    ``bucket`` distinct values of one key, however many rows the key has. ``count`` names a column of how often a row counts.
    """
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg((F.count(F.lit(1)) if count is None else F.sum(count)).alias("_n"))
        .withColumn("_b", F.floor(F.col("_v") / bucket))
    )
    by_bucket = counts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_n"))
    per_key = Window.partitionBy(*keys)
    running = per_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = (
        by_bucket.withColumn("_before", F.sum("_n").over(running) - F.col("_n"))
        .withColumn("_total", F.sum("_n").over(per_key))
        .withColumn("_lo", F.floor((F.col("_total") - 1) / 2))
        .withColumn("_hi", F.floor(F.col("_total") / 2))
        .filter((F.col("_before") <= F.col("_hi")) & (F.col("_before") + F.col("_n") > F.col("_lo")))
        .select(*keys, "_b", "_before", "_lo", "_hi")
    )
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (
        counts.join(middle, [*keys, "_b"])
        .withColumn("_end", F.col("_before") + F.sum("_n").over(inside))
        .withColumn("_start", F.col("_end") - F.col("_n"))
    )

    def at(rank: str):
        return F.max(F.when((F.col("_start") <= F.col(rank)) & (F.col(rank) < F.col("_end")), F.col("_v")))

    return ranked.groupBy(*keys).agg(F.floor((at("_lo") + at("_hi")) / 2 + 0.5).cast("long").alias(out))
