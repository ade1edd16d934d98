"""Marketplace item summaries (eBay browse shape) to raw listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from garderobe.functions.hints import market_color, market_condition, market_length
from garderobe.functions.markup import affiliate_url
from garderobe.functions.money import half_up

ITEM = (
    "itemId string, title string, price struct<value:string,currency:string>, image struct<imageUrl:string>, "
    "additionalImages array<struct<imageUrl:string>>, condition string, conditionId string, itemWebUrl string, "
    "itemAffiliateWebUrl string, localizedAspects array<struct<name:string,value:string>>"
)
VINTAGE_TITLE = r"(?i)\bv(in)?t(a)?g\b|\bvintage\b"
ERA = r"(?i)\b(19[2-9]0)'?s\b"


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Item files, one item per line; broken lines land in ``_corrupt_record``."""
    return spark.read.schema(ITEM + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def aspect(name: str) -> Column:
    """All values of one item aspect, in order."""
    return F.expr(f"transform(filter(coalesce(localizedAspects, array()), a -> lower(trim(a.name)) = '{name}'), a -> a.value)")


def raw_listings(items: DataFrame, seen_ms: int, campaign_id: str | None = None) -> DataFrame:
    price = F.col("price.value").try_cast("double")
    rows = items.filter(F.col("itemWebUrl").isNotNull() & price.isNotNull()).withColumns({
        "_sizes": F.expr("filter(transform(filter(coalesce(localizedAspects, array()), a -> lower(trim(a.name)) = 'size'), a -> trim(a.value)), s -> s <> '')"),
        "_colors": aspect("color"), "_brand": F.get(aspect("brand"), F.lit(0)), "_decade": F.get(aspect("decade"), F.lit(0)),
        "_style": F.array_join(aspect("style"), " "), "_length": F.get(aspect("dress length"), F.lit(0)),
    })
    decade = F.nullif(F.col("_decade"), F.lit(""))
    era = F.coalesce(decade, F.nullif(F.lower(F.replace(F.regexp_extract("title", ERA, 0), F.lit("'"), F.lit(""))), F.lit("")))
    partner = F.col("itemAffiliateWebUrl")
    if campaign_id:
        partner = F.coalesce(partner, affiliate_url(F.col("itemWebUrl"), F.lit(campaign_id)))
    images = F.array_distinct(F.filter(F.concat(F.array("image.imageUrl"), F.coalesce(
        F.transform("additionalImages", lambda i: i["imageUrl"]), F.array().cast("array<string>"))), lambda u: u != ""))
    return rows.select(
        F.lit("ebay").alias("source_id"), F.col("itemId").alias("source_listing_id"), F.col("itemWebUrl").alias("source_url"),
        partner.alias("affiliate_url"), "title", F.lit(None).cast("string").alias("description"),
        F.nullif(F.col("_brand"), F.lit("")).alias("brand"), half_up(price * 100).alias("price_cents"),
        F.coalesce("price.currency", F.lit("USD")).alias("currency"), images.alias("image_urls"),
        F.col("_sizes").alias("size_labels"),
        F.expr("map_from_arrays(array_distinct(_sizes), transform(array_distinct(_sizes), s -> true))").alias("availability"),
        market_condition(F.col("conditionId"), F.col("condition")).alias("condition"),
        (decade.isNotNull() | F.col("title").rlike(VINTAGE_TITLE) | F.col("_style").rlike("(?i)vintage")).alias("is_vintage"),
        era.alias("era"),
        F.struct(market_length(F.col("_length")).alias("length_class"),
                 F.transform("_colors", lambda c: F.struct(F.lower(c).alias("name"), market_color(c).alias("family"))).alias("colors")).alias("hints"),
        F.lit(seen_ms).cast("long").alias("seen_ms"),
    )
