"""Storefront product JSON (Shopify products.json shape) to raw listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from garderobe.functions.audience import SIZE_LABEL, child_reason, is_dress_product
from garderobe.functions.brands import resolved_brand
from garderobe.functions.hints import text_hints
from garderobe.functions.markup import strip_html
from garderobe.functions.money import half_up

PRODUCT = (
    "id long, title string, handle string, body_html string, vendor string, product_type string, tags string, "
    "options array<struct<name:string,position:int>>, "
    "variants array<struct<title:string,option1:string,option2:string,option3:string,available:boolean,price:string>>, "
    "images array<struct<src:string,position:int,alt:string>>"
)
PAGE = f"domain string, products array<struct<{PRODUCT.replace(' string', ':string').replace(' long', ':long').replace(' array', ':array')}>>"


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Payload files, one page of products per line, with an explicit schema; broken lines land in ``_corrupt_record``."""
    return spark.read.schema(PAGE + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def line_counts(lines: DataFrame, field: str = "domain") -> DataFrame:
    """Lines of payload files read, and those of them that are no JSON object and are dropped."""
    broken = F.col("_corrupt_record").isNotNull()
    return lines.agg(F.count_if(broken | F.col(field).isNotNull()).alias("lines"), F.count_if(broken).alias("broken"))


def products(payloads: DataFrame) -> DataFrame:
    return payloads.select("domain", F.explode("products").alias("p")).select("domain", "p.*")


def tag_list(tags: Column) -> Column:
    """Tags come as a JSON array or as one comma separated string."""
    parsed = F.from_json(tags, "array<string>")
    plain = F.transform(F.split(tags, ","), lambda t: F.trim(t))
    return F.when(F.coalesce(tags, F.lit("")) == "", F.array().cast("array<string>")).when(
        F.startswith(F.ltrim(tags), F.lit("[")), F.coalesce(parsed, F.array().cast("array<string>"))).otherwise(plain)


def labelled_variants() -> Column:
    """Variants as (label, available, price): the size option's value, else a variant title that looks like a size."""
    at = F.expr("get(filter(options, o -> o.name rlike '(?i)size'), 0).position")
    return F.expr(f"""transform(variants, v -> named_struct(
        'label', trim(coalesce(nullif(case _size_at when 1 then v.option1 when 2 then v.option2 when 3 then v.option3 end, ''),
                 if(v.title <> 'Default Title' and trim(v.title) rlike '{SIZE_LABEL.replace(chr(92), chr(92) * 2)}', v.title, null))),
        'available', v.available, 'price', try_cast(v.price as double)))"""), at


def with_stock(df: DataFrame) -> DataFrame:
    """Adds sizes, availability (any variant of a size in stock; a missing flag counts as in stock) and stock flags."""
    variants, at = labelled_variants()
    staged = df.withColumn("_size_at", at).withColumn("_v", variants).withColumn(
        "size_labels", F.expr("array_distinct(transform(filter(_v, x -> x.label <> ''), x -> x.label))"))
    return staged.withColumns({
        "availability": F.expr("map_from_arrays(size_labels, transform(size_labels, l -> exists(_v, x -> x.label = l and "
                               "coalesce(x.available, true))))"),
        "has_stock_signal": F.expr("exists(_v, x -> x.available is not null)"),
        "any_available": F.expr("exists(_v, x -> coalesce(x.available, false))"),
    })


def raw_listings(payloads: DataFrame, stores: DataFrame, seen_ms: int, excluded: DataFrame | None = None) -> DataFrame:
    """Raw listings of the category for adults. ``stores`` (domain, display_name, brand_name, brand_mode, known_brands, currency);
    ``excluded`` (domain, id) lists members of children's collections."""
    p = products(payloads)
    if excluded is not None:
        p = p.join(excluded.select("domain", "id"), ["domain", "id"], "left_anti")
    p = with_stock(p.withColumn("_tags", tag_list(F.col("tags"))))
    alts = F.expr("array_join(filter(transform(images, i -> i.alt), a -> a <> ''), ' ')")
    text = F.concat_ws("\n", "title", F.coalesce("product_type", F.lit("")), F.array_join("_tags", " "), alts)
    rows = p.filter(is_dress_product(F.col("product_type"), F.col("_tags"), F.col("title"))).filter(
        child_reason(text, F.col("size_labels")).isNull())
    rows = rows.withColumns({
        "_price": F.expr("coalesce(array_min(transform(filter(_v, x -> coalesce(x.available, true) and x.price >= 0), x -> x.price)), "
                         "array_min(transform(filter(_v, x -> x.price >= 0), x -> x.price)))"),
        "image_urls": F.expr("array_distinct(filter(transform(array_sort(images, (a, b) -> coalesce(a.position, 0) - coalesce(b.position, 0)), "
                             "i -> i.src), s -> s <> ''))"),
        "_hint_text": F.concat_ws(" ", F.coalesce("product_type", F.lit("")), F.array_join("_tags", " "), "title", F.coalesce("vendor", F.lit(""))),
    }).filter(F.col("_price").isNotNull())
    rows = rows.join(stores, "domain")
    vendor = F.trim(strip_html(F.coalesce("vendor", F.lit(""))))
    return rows.select(
        F.concat(F.lit("shopify:"), "domain").alias("source_id"),
        F.col("id").cast("string").alias("source_listing_id"),
        F.concat(F.lit("https://"), "domain", F.lit("/products/"), "handle").alias("source_url"),
        F.lit(None).cast("string").alias("affiliate_url"),
        strip_html(F.col("title")).alias("title"),
        F.nullif(strip_html(F.col("body_html")), F.lit("")).alias("description"),
        resolved_brand(vendor, F.col("display_name"), F.col("brand_name"), F.col("brand_mode"), F.col("known_brands")).alias("brand"),
        half_up(F.col("_price") * 100).alias("price_cents"),
        F.coalesce("currency", F.lit("USD")).alias("currency"),
        "image_urls", "size_labels", "availability", F.lit("new").alias("condition"), F.lit(False).alias("is_vintage"),
        F.lit(None).cast("string").alias("era"), text_hints("_hint_text").alias("hints"), F.lit(seen_ms).cast("long").alias("seen_ms"),
    ).dropDuplicates(["source_id", "source_listing_id"])
