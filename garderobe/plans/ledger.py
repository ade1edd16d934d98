"""Model usage by day: cost by price table, budget flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Token weights of cached input, batch discount, price of unlisted models per million tokens.
CACHE_READ, CACHE_WRITE, BATCH = 0.1, 1.25, 0.5
DEFAULT_IN, DEFAULT_OUT = 3.0, 15.0


def costed(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds ``cost_usd`` to (model, input_tokens, output_tokens, cache_read, cache_write, batch) rows."""
    rows = calls.join(prices.select("model", "input_usd", "output_usd"), "model", "left")
    inputs = (F.col("input_tokens") + CACHE_READ * F.col("cache_read") + CACHE_WRITE * F.col("cache_write")) / 1_000_000
    cost = inputs * F.coalesce("input_usd", F.lit(DEFAULT_IN)) + F.col("output_tokens") / 1_000_000 * F.coalesce("output_usd", F.lit(DEFAULT_OUT))
    return rows.withColumn("cost_usd", cost * F.when(F.col("batch"), BATCH).otherwise(1.0)).drop("input_usd", "output_usd")


def usage_ledger(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """(day, model, calls, tokens, cost)."""
    return costed(calls, prices).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "model").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum(F.col("input_tokens") + F.col("cache_read") + F.col("cache_write")).alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.sum("cost_usd").alias("cost_usd"))


def budget_flags(ledger: DataFrame, daily_budget_usd: float) -> DataFrame:
    """Spend per day, whether the day is at or over budget, and the running total over the (few) days."""
    days = ledger.groupBy("day").agg(F.sum("cost_usd").alias("spent"))
    running = F.sum("spent").over(Window.partitionBy(F.substring("day", 1, 4)).orderBy("day"))
    return days.withColumns({"over": F.col("spent") >= daily_budget_usd, "year_to_date": running})
