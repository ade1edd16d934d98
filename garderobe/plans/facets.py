"""Facet values of the active catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garderobe.operators.filters import active, usd_price


def brands(listings: DataFrame) -> DataFrame:
    return listings.filter(active() & F.col("brand").isNotNull()).select("brand").distinct()


def color_families(listings: DataFrame, extractions: DataFrame) -> DataFrame:
    live = listings.filter(active()).select("listing_id")
    families = extractions.join(live, "listing_id", "left_semi").select(F.explode("colors").alias("c"))
    return families.select(F.lower("c.family").alias("family")).filter(F.col("family").isNotNull()).distinct()


def price_range(listings: DataFrame) -> DataFrame:
    usd = usd_price()
    return listings.filter(active()).agg(
        F.coalesce(F.min(usd), F.lit(0)).alias("low"), F.coalesce(F.max(usd), F.lit(0)).alias("high")
    )


def facets(listings: DataFrame, extractions: DataFrame) -> DataFrame:
    """Long table (facet, value) of brands, color families and the USD price range."""
    prices = price_range(listings)
    parts = [
        brands(listings).select(F.lit("brand").alias("facet"), F.col("brand").alias("value")),
        color_families(listings, extractions).select(F.lit("color").alias("facet"), F.col("family").alias("value")),
        prices.select(F.lit("price_min").alias("facet"), F.col("low").cast("string").alias("value")),
        prices.select(F.lit("price_max").alias("facet"), F.col("high").cast("string").alias("value")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
