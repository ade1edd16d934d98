"""Payload, page and crawl sources, fit reports, decks, seasons and the usage ledger, on data derived from the given tables."""

from pyspark.sql import functions as F

from garderobe.functions import markup as M
from garderobe.functions.model_info import model_info
from garderobe.functions.named import register
from garderobe.plans import deck, feed, fit, ledger, seasons
from garderobe.session import scratch_path, spread, stage
from garderobe.sources import crawl, marketplace, storefront, structured_pages
from garderobe.sources import events as EV
from garderobe.sources import tables as T
from workload.bindings import NOW, OWNED, pick, sql
from workload.registry import query

K = "p_partkey"


# --- storefront payloads ---------------------------------------------------------------------------------------
def payloads(spark, d):
    """Product pages as JSON lines, written and read back like payload files."""
    variant = "named_struct('title', {t}, 'option1', {o}, 'option2', 'Red', 'option3', cast(null as string), 'available', {a}, 'price', {p})"
    v1 = variant.format(t="'S / Red'", o="' S '", a=f"{K} % 3 = 0", p="cast(p_retailprice as string)")
    v2 = variant.format(t="'M / Red'", o="'M'", a=f"if({K} % 5 = 0, null, {K} % 2 = 0)", p="cast(p_retailprice - 100 as string)")
    v3 = variant.format(t="'M / Blue'", o="'M'", a="false", p="'n/a'")
    row = T.read(spark, d, "part").selectExpr(
        f"concat('shop', {K} % 5, '.example.com') as domain",
        f"array(named_struct('id', {K}, 'title', concat('<b>', p_name, if({K} % 4 = 1, ' dress', ''), '</b>'), 'handle', concat('h-', {K}), "
        f"'body_html', concat('<p>Soft &amp; light</p><script>x()</script><p>Line ', {K}, '</p>'), 'vendor', if({K} % 7 = 0, 'SP26B', p_brand), "
        f"'product_type', {T.pick(['Dresses', '', 'Tops', None], f'{K} % 4')}, 'tags', if({K} % 8 = 7, '[\"Summer Dress\",\"new\"]', 'new, linen'), "
        f"'options', array(named_struct('name', 'Color', 'position', 2), named_struct('name', 'Size', 'position', 1)), 'variants', array({v1}, {v2}, {v3}), "
        f"'images', array(named_struct('src', 'b.jpg', 'position', 2, 'alt', if({K} % 13 = 0, 'for kids', '')), named_struct('src', 'a.jpg', 'position', 1, 'alt', ''), "
        f"named_struct('src', 'a.jpg', 'position', 3, 'alt', '')))) as products")
    path = scratch_path(spark, "payloads")
    row.selectExpr("to_json(struct(*)) as value").write.text(path)
    return storefront.read_payloads(spark, path)


def stores(spark, d, prefix="shop"):
    rows = [(f"{prefix}{i}.example.com", f"Shop {i}", None, "single" if i == 0 else "multi", ["Brand#1"], "GBP" if i == 1 else None, 1.0) for i in range(5)]
    return spark.createDataFrame(rows, "domain string, display_name string, brand_name string, brand_mode string, known_brands array<string>, currency string, price_divisor double")


SHOP = f"""SELECT 'shopify:shop' || ({K} % 5) || '.example.com' AS source_id, CAST({K} AS VARCHAR) AS source_listing_id, p_name || CASE WHEN {K} % 4 = 1 THEN ' dress' ELSE '' END AS title,
  CASE WHEN p_brand = 'Brand#1' AND {K} % 7 <> 0 THEN 'Brand#1' WHEN {K} % 5 = 0 OR {K} % 7 = 0 THEN 'Shop ' || ({K} % 5) ELSE p_brand END AS brand,
  CAST(floor(100 * CASE WHEN {K} % 5 = 0 OR {K} % 2 = 0 THEN p_retailprice - 100 WHEN {K} % 3 = 0 THEN p_retailprice ELSE p_retailprice - 100 END + 0.5) AS BIGINT) AS price_cents,
  CASE WHEN {K} % 5 = 1 THEN 'GBP' ELSE 'USD' END AS currency, 'a.jpg,b.jpg' AS images, 'S,M' AS sizes, {K} % 3 = 0 AS s_in, {K} % 5 = 0 OR {K} % 2 = 0 AS m_in,
  'Soft & light' || chr(10) || 'Line ' || {K} AS description
FROM part WHERE ({K} % 4 = 0 OR {K} % 4 = 1 OR ({K} % 8 = 7)) AND {K} % 13 <> 0"""


@query("storefront_listings", sql(SHOP))
def _(spark, d):
    raw = storefront.raw_listings(payloads(spark, d), stores(spark, d), NOW)
    return raw.select("source_id", "source_listing_id", "title", "brand", "price_cents", "currency", F.array_join("image_urls", ",").alias("images"),
                      F.array_join("size_labels", ",").alias("sizes"), F.col("availability")["S"].alias("s_in"), F.col("availability")["M"].alias("m_in"), "description")


@query("payload_lines", sql(f"SELECT count(*) AS lines, count(*) FILTER ({K} % 9 = 4) AS broken FROM part"))
def _(spark, d):
    """Every ninth payload line is cut off."""
    path = scratch_path(spark, "payload-lines")
    line = F.expr(f"to_json(named_struct('domain', concat('shop', {K} % 5), 'products', array(named_struct('id', {K}, 'title', p_name))))")
    T.read(spark, d, "part").select(F.when(F.col(K) % 9 == 4, F.expr("left(p_name, 9)")).otherwise(line).alias("value")).write.text(path)
    return storefront.line_counts(storefront.read_payloads(spark, path))


@query("storefront_kids_excluded", sql(f"SELECT count(*) AS n FROM ({SHOP}) WHERE CAST(source_listing_id AS BIGINT) % 3 <> 0"))
def _(spark, d):
    kids = T.read(spark, d, "part").filter(f"{K} % 3 = 0").select(F.expr(f"concat('shop', {K} % 5, '.example.com')").alias("domain"), F.col(K).alias("id"))
    return storefront.raw_listings(payloads(spark, d), stores(spark, d), NOW, kids).agg(F.count(F.lit(1)).alias("n"))


# --- marketplace items -----------------------------------------------------------------------------------------
def items(spark, d):
    row = T.read(spark, d, "part").selectExpr(
        f"concat('v1|', {K}) as itemId", f"concat(p_name, if({K} % 6 = 0, ' 1970''s', ''), if({K} % 10 = 0, ' vintage', '')) as title",
        f"named_struct('value', if({K} % 9 = 0, 'free', cast(p_retailprice as string)), 'currency', if({K} % 2 = 0, 'GBP', null)) as price",
        "named_struct('imageUrl', 'x.jpg') as image", "array(named_struct('imageUrl', 'y.jpg'), named_struct('imageUrl', 'x.jpg')) as additionalImages",
        f"{T.pick(['Like new', 'Excellent', 'Pre-owned', 'Poor'], f'{K} % 4')} as condition", f"{T.pick(['1500', '2750', '3000', '4000', None], f'{K} % 5')} as conditionId",
        f"concat('https://market.example.com/itm/', {K}) as itemWebUrl",
        f"array(named_struct('name', ' Size', 'value', ' 8 '), named_struct('name', 'Brand', 'value', p_brand), named_struct('name', 'color', 'value', split(p_name, ' ')[0]), "
        f"named_struct('name', 'Dress Length', 'value', if({K} % 3 = 0, 'Above Knee, Mini', 'Long'))) as localizedAspects")
    path = scratch_path(spark, "items")
    row.selectExpr("to_json(struct(*)) as value").write.text(path)
    return marketplace.read_items(spark, path)


@query("marketplace_listings", sql(f"""SELECT 'v1|' || {K} AS source_listing_id, 'https://market.example.com/itm/' || {K} ||
  '?mkcid=1&mkrid=711-53200-19255-0&campid=77&toolid=10001&mkevt=1' AS affiliate_url, CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) AS price_cents, CASE WHEN {K} % 2 = 0 THEN 'GBP' ELSE 'USD' END AS currency,
  'x.jpg,y.jpg' AS images, '8' AS sizes, p_brand AS brand, CASE {K} % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'like_new' WHEN 2 THEN 'good' WHEN 3 THEN 'fair' ELSE
  {pick(['new', 'like_new', 'good', 'unknown'], f'{K} % 4')} END AS condition, {K} % 10 = 0 AS is_vintage, CASE WHEN {K} % 6 = 0 THEN '1970s' END AS era,
  CASE WHEN {K} % 3 = 0 THEN 'above_knee' ELSE 'maxi' END AS length_class, CASE split_part(p_name, ' ', 1) WHEN 'red' THEN 'red' WHEN 'blue' THEN 'blue' ELSE
  CASE WHEN contains('cold', 'gold') THEN '' ELSE 'multi' END END AS color FROM part WHERE {K} % 9 <> 0"""))
def _(spark, d):
    raw = marketplace.raw_listings(items(spark, d), NOW, "77")
    return raw.select("source_listing_id", "affiliate_url", "price_cents", "currency", F.array_join("image_urls", ",").alias("images"),
                      F.array_join("size_labels", ",").alias("sizes"), "brand", "condition", "is_vintage", "era", "hints.length_class",
                      F.get("hints.colors", F.lit(0))["family"].alias("color"))


# --- structured pages ------------------------------------------------------------------------------------------
def shop_pages(spark, d):
    """One product page per part in six shapes: plain (some with a repeated key, some with microdata too), graph, group with variants, raw control
    characters, microdata, nothing."""
    offer = f"named_struct('@type', 'Offer', 'price', cast(p_retailprice as string), 'priceCurrency', 'EUR', 'availability', if({K} % 5 = 0, 'https://schema.org/OutOfStock', 'InStock'))"
    base = f"'name', concat(p_name, if({K} % 7 = 0, ' shirt', ' dress')), 'brand', named_struct('name', p_brand), 'sku', concat('sku-', {K}), 'image', array('/i/1.jpg', 'https://cdn.example.com/2.jpg')"
    plain = f"to_json(named_struct('@type', 'Product', {base}, 'offers', {offer}))"
    graph = f"to_json(named_struct('@graph', array(named_struct('@type', array('Product'), {base}, 'offers', array({offer})))))"
    variant = "named_struct('@type', 'Product', 'size', '{s}', 'offers', named_struct('price', {p}, 'availability', {a}))"
    group = f"""to_json(named_struct('@type', 'ProductGroup', {base}, 'hasVariant', array({variant.format(s='S', p='p_retailprice', a="'InStock'")},
        {variant.format(s='M', p='p_retailprice - 50', a="'OutOfStock'")})))"""
    block = "concat('<html><head><script type=\"application/ld+json\">', {j}, '</script></head></html>')"
    micro = (f"concat('<div itemscope itemtype=\"https://schema.org/Product\"><h1 itemprop=\"name\">', p_name, if({K} % 7 = 0, ' shirt', ' dress'), '</h1><img itemprop=\"image\" src=\"/m.jpg\">"
             f"<div itemprop=\"offers\" itemscope itemtype=\"http://schema.org/Offer\"><meta itemprop=\"price\" content=\"', p_retailprice, '\"><meta itemprop=\"priceCurrency\" content=\"USD\"><link itemprop=\"availability\" "
             f"href=\"http://schema.org/InStock\"></div></div>')")
    doubled = f"if({K} % 4 = 0, concat('{{\"note\":1,\"note\":2,', substring({plain}, 2)), {plain})"
    return spread(T.read(spark, d, "part"), K).selectExpr(
        f"{K} as page_id", f"concat('shop', {K} % 5, '.example.com') as domain", f"concat('https://shop', {K} % 5, '.example.com/products/item-', {K}, '.html') as url",
        f"case {K} % 6 when 0 then concat({block.format(j=doubled)}, if({K} % 12 = 0, {micro}, '')) when 1 then {block.format(j=graph)} when 2 then {block.format(j=group)} "
        f"when 3 then {block.format(j=f'''replace({plain}, ' dress', concat(' ', chr(1), 'dress'))''')} when 4 then {micro} "
        f"else if({K} % 12 = 5, concat('<script type=\"application/ld+json\">{{broken</script>'), '<html><p>nothing here</p></html>') end as html")


OUT = f"""SELECT {K} AS page_id, CASE WHEN {K} % 6 = 5 THEN CASE WHEN {K} % 12 = 5 THEN 'malformed_only' ELSE 'no_jsonld_product' END WHEN {K} % 7 = 0 AND {K} % 6 <> 3 THEN 'not_a_dress'
  WHEN {K} % 7 = 0 THEN 'not_a_dress' ELSE 'ok' END AS outcome FROM part"""


@query("page_outcomes", sql("SELECT page_id, outcome FROM o", o=OUT))
def _(spark, d):
    _, outcomes = structured_pages.load_pages(shop_pages(spark, d), stores(spark, d), NOW)
    return outcomes.select("page_id", "outcome")


@query("page_listings", sql(f"""SELECT page_id, CASE WHEN {K} % 6 = 4 THEN 'item-' || {K} ELSE 'sku-' || {K} END AS source_listing_id, CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) AS price_cents,
  CASE WHEN {K} % 6 = 2 THEN 'S,M' ELSE '' END AS sizes, CASE WHEN {K} % 6 = 4 OR {K} % 5 = 0 THEN CASE WHEN {K} % 6 <> 4 AND p_brand = 'Brand#1' THEN p_brand ELSE 'Shop ' || ({K} % 5) END ELSE p_brand END AS brand,
  CASE WHEN {K} % 6 = 4 THEN 'USD' WHEN {K} % 6 = 2 THEN CASE WHEN {K} % 5 = 1 THEN 'GBP' ELSE 'USD' END ELSE 'EUR' END AS currency,
  CASE WHEN {K} % 6 = 4 THEN 'https://shop' || ({K} % 5) || '.example.com/m.jpg' ELSE 'https://shop' || ({K} % 5) || '.example.com/i/1.jpg,https://cdn.example.com/2.jpg' END AS images
  FROM o JOIN part ON {K} = page_id WHERE outcome = 'ok'""", o=OUT))
def _(spark, d):
    listings, _ = structured_pages.load_pages(shop_pages(spark, d), stores(spark, d), NOW)
    return listings.select("page_id", "source_listing_id", "price_cents", F.array_join("size_labels", ",").alias("sizes"), "brand", "currency",
                           F.array_join("image_urls", ",").alias("images"))


@query("page_stock_signals", sql(f"SELECT {K} AS page_id, CASE WHEN {K} % 6 IN (2, 4) OR {K} % 5 <> 0 THEN 'in_stock' ELSE 'out_of_stock' END AS stock FROM part WHERE {K} % 6 <> 5"))
def _(spark, d):
    from garderobe.plans.verify import stock_signal
    return stock_signal(structured_pages.page_offers(shop_pages(spark, d)))


@query("page_blocks", sql(f"SELECT {K} AS page_id, ({K} % 6 = 3 AND {K} % 7 <> 0) OR {K} % 12 = 5 AS repaired, {K} % 12 <> 5 AS usable FROM part WHERE {K} % 6 IN (0, 1, 2, 3) OR {K} % 12 = 5"))
def _(spark, d):
    return structured_pages.json_blocks(shop_pages(spark, d)).select("page_id", "repaired", F.col("json").isNotNull().alias("usable"))


# --- web pages of the given tables -----------------------------------------------------------------------------
@query("pages_stripped", sql(r"""SELECT page_id, len(t) AS n, md5(t) AS digest FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(
  regexp_replace(regexp_replace(html, '(?s)<style[^>]*>.*?</style>|<script[^>]*>.*?</script>', ' ', 'gi'), '<br\s*/?>', chr(10), 'gi'), '</(p|div|li|h[1-6])>', chr(10), 'gi'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '),
  '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM pages)"""))
def _(spark, d):
    text = M.strip_html(F.col("html"))
    return T.read(spark, d, "pages").select("page_id", text.alias("t")).select("page_id", F.length("t").cast("long").alias("n"), F.md5(F.encode("t", "UTF-8")).alias("digest"))


@query("canonical_urls", sql(r"""SELECT page_id, CASE WHEN len(kept) > 0 THEN base || '?' || array_to_string(kept, '&') ELSE base END AS url FROM (SELECT page_id, split_part(u, '?', 1) AS base,
  list_filter(string_split(CASE WHEN contains(u, '?') THEN split_part(u, '?', 2) ELSE '' END, '&'), lambda x: x <> '' AND NOT regexp_matches(split_part(x, '=', 1), '^(utm_|fbclid|gclid|mc_|igsh|ref$|si$)', 'i')) AS kept
  FROM (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages))"""))
def _(spark, d):
    return T.read(spark, d, "pages").select("page_id", M.canonical_url(F.col("url")).alias("url"))


@query("entities_decoded", sql(f"SELECT {K}, chr(65 + CAST({K} % 26 AS INTEGER)) || ' & <é> ' || chr(8364) AS text FROM part"))
def _(spark, d):
    raw = F.expr(f"concat('&#', 65 + {K} % 26, '; &amp; &lt;&#xE9;&gt; &#x20aC;')")
    return T.read(spark, d, "part").select(K, M.decode_entities(raw).alias("text"))


@query("named_functions", sql(f"""SELECT listing_id, usd_cents, CASE WHEN x < 31.5 THEN 'micro' WHEN x < 34.5 THEN 'mini' WHEN x < 37.5 THEN 'above_knee' WHEN x < 41.5 THEN 'knee'
  WHEN x < 45.5 THEN 'midi' WHEN x < 51 THEN 'mid_calf' WHEN x < 57.5 THEN 'maxi' ELSE 'floor' END AS length_class, chr(65 + CAST(listing_key % 26 AS INTEGER)) || lower(title) || '€' AS text,
  len(list_filter(string_split(lower(title), ' '), lambda w: w <> '')) AS n_words FROM (SELECT *, 20 + p_size AS x FROM listings)""", "listings"))
def _(spark, d):
    register(spark)
    T.listings(spark, d).createOrReplaceTempView("named_listings")
    T.read(spark, d, "part").createOrReplaceTempView("named_parts")
    return spark.sql("""select listing_id, us_cents(price_cents, currency) as usd_cents, length_class_of(20 + p_size) as length_class,
        numeric_references(concat('&#', 65 + listing_key % 26, ';', lower(title), '&#x20aC;')) as text, size(words_of(title)) as n_words
        from named_listings join named_parts on p_partkey = listing_key""")


@query("stated_model_heights", sql("""SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 1) THEN 68.0 + doc_id % 4 WHEN doc_id % 4 = 2 THEN floor(178 / 2.54 * 10 + 0.5) / 10 END AS height,
  CASE WHEN doc_id % 4 = 0 THEN 'S' WHEN doc_id % 4 = 2 THEN 'US 4' END AS size_worn FROM documents"""))
def _(spark, d):
    said = F.expr("element_at(array('. The model is 5''8\" tall and wears a size small', '. Mannequin height: 5 ft 9 in', '. She is 178 cm tall, wearing size US 4', '. Length: 5''9\" approx'), cast(doc_id % 4 + 1 as int))")
    rows = T.read(spark, d, "documents").select("doc_id", model_info(F.concat("text", said)).alias("m"))
    return rows.select("doc_id", "m.height", "m.size_worn")


# --- crawl -----------------------------------------------------------------------------------------------------
def sitemaps(spark, d):
    """One url set per supplier nation listing its pages, dated by supplier key."""
    entry = ("concat('<url><loc>https://site', s_nationkey, '.example.com/', if(s_suppkey % 3 = 0, 'dress', 'item'), '/', s_suppkey, if(s_suppkey % 7 = 0, '?a=1&amp;b=2', ''), '</loc>', "
             "if(s_suppkey % 2 = 0, concat('<lastmod>2024-01-', lpad(s_suppkey % 28 + 1, 2, '0'), '</lastmod>'), ''), '</url>')")
    return T.read(spark, d, "supplier").selectExpr("concat('site', s_nationkey) as store", f"concat('<urlset>', {entry}, '</urlset>') as xml")


def robots(spark, d):
    return T.read(spark, d, "nation").selectExpr("concat('site', n_nationkey, '.example.com') as host", "concat('User-agent: *\\nDisallow: /item/1\\nAllow: /item/12\\n\\nUser-agent: OtherBot\\nDisallow: /\\n', "
                                                 "if(n_nationkey % 5 = 0, 'User-agent: shopcrawler\\nDisallow: /*?a=\\n', '')) as txt")


URLS = """SELECT s_nationkey AS nk, 'site' || s_nationkey AS store, s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'dress' ELSE 'item' END AS dir,
  'https://site' || s_nationkey || '.example.com/' || CASE WHEN s_suppkey % 3 = 0 THEN 'dress' ELSE 'item' END || '/' || s_suppkey || CASE WHEN s_suppkey % 7 = 0 THEN '?a=1&b=2' ELSE '' END AS loc,
  CASE WHEN s_suppkey % 2 = 0 THEN epoch_us(make_timestamp(2024, 1, s_suppkey % 28 + 1, 0, 0, 0)) // 1000 END AS lastmod_ms FROM supplier"""
ALLOWED = """SELECT *, CASE WHEN nk % 5 = 0 THEN NOT contains(loc, '?a=') ELSE dir = 'dress' OR NOT starts_with(CAST(k AS VARCHAR), '1') OR starts_with(CAST(k AS VARCHAR), '12') END AS allowed FROM u"""


@query("sitemap_rows", sql("SELECT store, loc, lastmod_ms FROM u", u=URLS))
def _(spark, d):
    return crawl.sitemap_rows(sitemaps(spark, d)).select("store", "loc", "lastmod_ms")


@query("robots_verdicts", sql("SELECT loc, allowed FROM a", u=URLS, a=ALLOWED))
def _(spark, d):
    rows = crawl.sitemap_rows(sitemaps(spark, d)).withColumns({"host": F.try_parse_url("loc", F.lit("HOST")), "path": F.try_parse_url("loc", F.lit("FILE"))})
    return crawl.allowed(rows, crawl.robots_rules(robots(spark, d)), "shopcrawler").select("loc", "allowed")


@query("crawl_plan", sql("""SELECT store, loc, rank FROM (SELECT *, row_number() OVER (PARTITION BY store ORDER BY CASE WHEN dir = 'dress' THEN 0 ELSE 1 END, coalesce(lastmod_ms, 0) DESC, loc) AS rank
  FROM a WHERE allowed AND NOT ends_with(loc, '3')) WHERE rank <= 3""", u=URLS, a=ALLOWED))
def _(spark, d):
    plan = T.read(spark, d, "nation").selectExpr("concat('site', n_nationkey) as store", "'/(dress|item)/[0-9]+' as product_url_pattern", "array('3$') as exclude_url_patterns")
    return crawl.crawl_plan(sitemaps(spark, d), robots(spark, d), plan, "shopcrawler", 3)


# --- event batches ---------------------------------------------------------------------------------------------
BAD = "id % 6 = 0 AND event_type IN ('quiz_step_completed', 'quiz_started')"


def noisy_events(spark, d):
    """The event feed with unknown props, types and out-of-range values mixed in, as a stored table."""
    return stage(T.analytics_events(spark, d).withColumns({
        "props": F.expr("if(id % 6 = 0 and event_type = 'quiz_step_completed', '{\"step\": 99}', if(id % 6 = 0 and event_type = 'quiz_started', '{\"x\": 1}', props))"),
        "event_type": F.expr("if(id % 10 = 1, 'mystery', event_type)")}), "noisy")


@query("event_validation", sql(f"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN id % 10 = 1 THEN 'type' WHEN id % 6 = 0 AND event_type = 'quiz_started' THEN 'props' WHEN id % 6 = 0 AND
  event_type = 'quiz_step_completed' THEN 'value' WHEN event_type = 'filter_applied' AND kind IS NULL THEN 'value' WHEN event_type = 'search_submitted' AND query = '' THEN 'value'
  ELSE 'valid' END AS reason FROM analytics) GROUP BY reason""", "analytics"))
def _(spark, d):
    valid, rejects = EV.split_events(noisy_events(spark, d))
    both = valid.select(F.lit("valid").alias("reason")).unionByName(rejects.select("reason"))
    return both.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("event_sink", sql("SELECT CAST(make_timestamp(created_ms * 1000)::DATE AS VARCHAR) AS day, count(*) AS n FROM analytics GROUP BY ALL", "analytics"))
def _(spark, d):
    path = scratch_path(spark, "events")
    EV.append_events(T.analytics_events(spark, d), path)
    return spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


# --- fit, decks ------------------------------------------------------------------------------------------------
@query("fit_rows", sql("""SELECT user_id, in_catalog, verdict AS size_match FROM (SELECT u.user_id, l.listing_key % 2 = 0 AS in_catalog, CASE WHEN len(sizes) = 0 THEN 'unknown' WHEN NOT list_has_any(sizes, [8, 10])
  THEN 'not_listed' WHEN l.listing_key % 3 = 0 THEN 'listed_sold_out' ELSE 'in_your_size' END AS verdict FROM users u JOIN """ + OWNED + """ l ON l.owner = u.user_id)""", "users", "listings"))
def _(spark, d):
    c = T.candidates(spark, d)
    asked = c.selectExpr("listing_key as check_id", f"listing_key % {T.key_count(spark, d, 'customer', 'c_custkey')} as user_id", "if(listing_key % 2 = 0, concat(source_url, '&utm_medium=x#frag'), 'https://else.example.com/x') as url",
                         "array('M') as size_labels", "map('M', listing_key % 3 <> 0) as availability", "length_inches", "length_class", "length_basis")
    return fit.fit_rows(asked, T.users(spark, d), c).select("user_id", "in_catalog", "size_match")


COSINE = "list_cosine_similarity(a.vector::DOUBLE[], b.vector::DOUBLE[])"


@query("fit_similar_rack", sql(f"""SELECT user_id AS check_id, listing_id, rank, fits, basis FROM (SELECT *, bool_or(fits) OVER (PARTITION BY user_id) AS any_fit, 'embedding' AS basis FROM (SELECT *,
  row_number() OVER (PARTITION BY user_id ORDER BY fits DESC, score DESC, listing_id) AS rank FROM (SELECT a.vec_id AS user_id, b.listing_id, round({COSINE}, 9) AS score, coalesce((len(u.sizes) = 0
  OR list_has_any(l.size_normalized, u.sizes)) AND (budget_max_cents IS NULL OR usd_cents <= budget_max_cents), false) AS fits
  FROM (SELECT vec_id, embedding AS vector FROM embeddings) a JOIN users u ON u.user_id = a.vec_id, vectors b JOIN listings l ON l.listing_id = b.listing_id)) WHERE rank <= 8) WHERE fits OR NOT any_fit""", "users", "listings", "vectors"))
def _(spark, d):
    checks = T.read(spark, d, "embeddings").select(F.col("vec_id").alias("check_id"), F.col("vec_id").alias("user_id"), F.col("embedding").alias("vector"))
    return fit.similar_rack(checks, T.users(spark, d), T.listings(spark, d), T.embeddings(spark, d)).select("check_id", "listing_id", "rank", "fits", "basis")


@query("deck_completion", sql("""SELECT user_id, positives, cards, CASE WHEN positives >= 5 THEN 'target' WHEN cards >= 30 THEN 'cap' END AS reason, CAST(greatest(0, least(7, 30 - cards)) AS INTEGER) AS next_batch
FROM (SELECT user_id, count(*) FILTER (verdict IN ('like', 'save')) AS positives, count(*) AS cards FROM swipes GROUP BY user_id)""", "swipes"))
def _(spark, d):
    return deck.completion(T.swipes(spark, d))


EXCL = """SELECT user_id, kind, value FROM (SELECT user_id, unnest(['silhouette', 'color']) AS kind, unnest([silhouette, families[1]]) AS value, verdict IN ('like', 'save') AS up FROM swipes JOIN attrs USING (listing_id))
  WHERE value IS NOT NULL GROUP BY ALL HAVING count(*) FILTER (NOT up) >= 2 AND count(*) FILTER (up) = 0"""
@query("deck_exclusions", sql(EXCL, "swipes", "attrs"))
def _(spark, d):
    return deck.exclusions(T.swipes(spark, d), T.candidates(spark, d))


@query("calibration_deck")
def _(spark, d):
    users, catalog = T.users(spark, d), T.candidates(spark, d)
    live = feed.live_catalog(catalog, T.sources(spark, d), NOW)
    pools = stage(feed.pools(users, live), "pools")
    ranked = feed.ranked(feed.scored_pairs(users, live, pools, NOW))
    swipes = T.swipes(spark, d)
    pooled = catalog.join(pools.select("listing_id").distinct(), "listing_id", "left_semi")
    return deck.calibration_deck(ranked, pooled, deck.exclusions(swipes, catalog), swipes)


# --- seasons, ledger -------------------------------------------------------------------------------------------
MEASURED = {"skin": "20.0::DOUBLE + c_custkey % 60", "hair": "10.0::DOUBLE + c_custkey % 50", "warmth": "((c_custkey % 9) - 4) * 0.1::DOUBLE",
            "chroma": "(c_custkey % 8) * 0.1::DOUBLE", "contrast": "(c_custkey % 11) * 0.1::DOUBLE"}
AXES = f"""SELECT c_custkey AS user_id, {MEASURED['warmth']} AS warmth, 0.6::DOUBLE * ({MEASURED['skin']}) + 0.4::DOUBLE * ({MEASURED['hair']}) AS depth, {MEASURED['chroma']} AS chroma,
  {MEASURED['contrast']} AS contrast, c_custkey % 10 = 0 AS poor, {MEASURED['skin']} AS skin FROM customer"""
SEASON = """CASE WHEN depth <= 32 THEN CASE WHEN warmth > 0.15 THEN 'dark_autumn' ELSE 'dark_winter' END WHEN depth >= 62 THEN CASE WHEN warmth > 0.15 THEN 'light_spring' ELSE 'light_summer' END
  WHEN chroma >= 0.55 OR contrast >= 0.65 THEN CASE WHEN warmth > 0.15 THEN 'bright_spring' ELSE 'bright_winter' END WHEN chroma <= 0.3 THEN CASE WHEN warmth > 0.15 THEN 'soft_autumn' ELSE 'soft_summer' END
  WHEN warmth > 0.15 THEN CASE WHEN depth < 48 THEN 'true_spring' ELSE 'true_autumn' END WHEN contrast >= 0.45 THEN 'true_winter' WHEN warmth < -0.15 THEN 'true_summer' ELSE 'soft_summer' END"""


@query("measured_seasons", sql(f"""SELECT user_id, {SEASON} AS season, greatest(0.3, least(0.9, floor((0.8::DOUBLE - CASE WHEN abs(warmth) < 0.15 THEN 0.15 ELSE 0 END - CASE WHEN poor THEN 0.25 ELSE 0 END
  - CASE WHEN depth > 32 AND depth < 40 THEN 0.05 ELSE 0 END)::DOUBLE * 100 + 0.5) / 100)) AS confidence, poor OR skin < 35 AS caveat FROM a""", a=AXES))
def _(spark, d):
    c = T.read(spark, d, "customer").select("c_custkey", *[F.expr(v.replace("::DOUBLE", "D")).alias(k) for k, v in MEASURED.items()])
    rows = c.select(F.col("c_custkey").alias("user_id"), "skin", F.when(F.col("c_custkey") % 10 == 0, "poor").otherwise("good").alias("sample_quality"),
                    seasons.axes_from_measured(F.col("skin"), F.col("hair"), F.col("warmth"), F.col("chroma"), F.col("contrast")).alias("axes"))
    cav = seasons.caveat(F.col("sample_quality"), F.col("skin"), F.lit(10.0), F.lit(14.0))
    return seasons.classify(rows).select("user_id", "season", "confidence", cav.isNotNull().alias("caveat"))


QUIZ = {"vein_color": list(seasons.VEINS), "jewelry_metal": list(seasons.METALS), "white_vs_cream": list(seasons.WHITES), "sun_reaction": list(seasons.SKIN_DEPTH),
        "natural_hair": list(seasons.HAIR_DEPTH), "eye_color": list(seasons.EYE_CHROMA)}
ANSWERS = "SELECT c_custkey AS user_id, " + ", ".join(f"{pick(v, f'c_custkey // {i + 1} % {len(v)}')} AS {k}" for i, (k, v) in enumerate(QUIZ.items())) + " FROM customer"


def case(table, column, default="NULL"):
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in table.items()) + f" ELSE {default} END"


@query("quiz_seasons", sql(f"SELECT user_id, {SEASON} AS season FROM ax", q=ANSWERS, ax=f"""SELECT user_id, greatest(-1, least(1, {case(seasons.VEINS, 'vein_color')} + {case(seasons.METALS, 'jewelry_metal')}
  + {case(seasons.WHITES, 'white_vs_cream')} + {case(seasons.SUN_WARMTH, 'sun_reaction')} + {case(seasons.HAIR_WARMTH, 'natural_hair', 0)} + {case(seasons.EYE_WARMTH, 'eye_color', 0)})) AS warmth,
  0.6::DOUBLE * {case(seasons.SKIN_DEPTH, 'sun_reaction')} + 0.4::DOUBLE * {case(seasons.HAIR_DEPTH, 'natural_hair')} AS depth, ({case(seasons.EYE_CHROMA, 'eye_color')} + {case(seasons.HAIR_CHROMA, 'natural_hair')}) / 2 AS chroma,
  least(1, abs({case(seasons.SKIN_DEPTH, 'sun_reaction')} - {case(seasons.HAIR_DEPTH, 'natural_hair')}) / 60) AS contrast FROM q"""))
def _(spark, d):
    answers = T.read(spark, d, "customer").selectExpr("c_custkey as user_id", *[f"{T.pick(v, f'c_custkey div {i + 1} % {len(v)}')} as {k}" for i, (k, v) in enumerate(QUIZ.items())])
    rows = answers.withColumns({"axes": seasons.axes_from_quiz(), "sample_quality": F.lit("good")})
    return seasons.classify(rows).select("user_id", "season")


# A table of palettes from the nations: each is a color of one season, every fourth one to avoid; some seasons have none.
PALETTE_SEASONS = ["dark_autumn", "dark_winter", "light_spring", "light_summer", "bright_spring", "soft_summer", "true_autumn", None]


@query("season_palettes", sql(f"""SELECT user_id, season, coalesce(palette, '') AS palette, coalesce(avoid, '') AS avoid FROM (SELECT user_id, {SEASON} AS season FROM a) LEFT JOIN
  (SELECT season, string_agg(name || '#' || n_nationkey, ',' ORDER BY n_nationkey) FILTER (n_nationkey % 4 <> 0) AS palette, string_agg(name || '#' || n_nationkey, ',' ORDER BY n_nationkey) FILTER (n_nationkey % 4 = 0) AS avoid
   FROM (SELECT *, lower(n_name) AS name, {pick(PALETTE_SEASONS, 'n_nationkey % 8')} AS season FROM nation) WHERE season IS NOT NULL GROUP BY season) USING (season)""", a=AXES))
def _(spark, d):
    colors = T.read(spark, d, "nation").selectExpr(f"{T.pick(PALETTE_SEASONS, 'n_nationkey % 8')} as season", "n_nationkey as place", "concat('#', n_nationkey) as hex",
                                                   "lower(n_name) as name", "n_nationkey % 4 = 0 as avoid")
    c = T.read(spark, d, "customer").select("c_custkey", *[F.expr(v.replace("::DOUBLE", "D")).alias(k) for k, v in MEASURED.items()])
    rows = c.select(F.col("c_custkey").alias("user_id"), F.lit("good").alias("sample_quality"),
                    seasons.axes_from_measured(F.col("skin"), F.col("hair"), F.col("warmth"), F.col("chroma"), F.col("contrast")).alias("axes"))
    said = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: F.concat(x["name"], x["hex"])), ","), F.lit(""))
    return seasons.classify(rows, seasons.palette_table(colors)).select("user_id", "season", said("palette").alias("palette"), said("avoid").alias("avoid"))


def calls(spark, d):
    return T.read(spark, d, "events").selectExpr("cast(ts as timestamp) as ts", "if(event_type = 'view', 'small', if(event_type = 'click', 'large', 'other')) as model",
                                                 "event_id % 1000 * 100 as input_tokens", "event_id % 77 * 10 as output_tokens", "event_id % 5 * 1000 as cache_read", "event_id % 3 * 1000 as cache_write",
                                                 "event_id % 2 = 0 as batch")


def prices(spark):
    return spark.createDataFrame([("small", 1.0, 5.0), ("large", 3.0, 15.0)], "model string, input_usd double, output_usd double")


LEDGER = """SELECT strftime(ts, '%Y-%m-%d') AS day, model, count(*) AS calls, CAST(sum(i + cr + cw) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens,
  sum(((i + 0.1::DOUBLE * cr + 1.25::DOUBLE * cw) / 1000000 * CASE model WHEN 'small' THEN 1 ELSE 3 END + o / 1000000.0::DOUBLE * CASE model WHEN 'small' THEN 5 ELSE 15 END) * CASE WHEN event_id % 2 = 0 THEN 0.5::DOUBLE ELSE 1 END) AS cost
FROM (SELECT *, CASE event_type WHEN 'view' THEN 'small' WHEN 'click' THEN 'large' ELSE 'other' END AS model, event_id % 1000 * 100 AS i, event_id % 77 * 10 AS o, event_id % 5 * 1000 AS cr, event_id % 3 * 1000 AS cw FROM events) GROUP BY ALL"""


@query("usage_ledger", sql("SELECT day, model, calls, input_tokens, output_tokens, round(cost, 8) AS cost_usd FROM l", l=LEDGER))
def _(spark, d):
    return ledger.usage_ledger(calls(spark, d), prices(spark)).withColumn("cost_usd", F.round("cost_usd", 8))


@query("budget_flags", sql("SELECT day, round(s, 8) AS spent, s >= 30 AS \"over\", round(sum(s) OVER (ORDER BY day), 3) AS year_to_date FROM (SELECT day, sum(cost) AS s FROM l GROUP BY day)", l=LEDGER))
def _(spark, d):
    flags = ledger.budget_flags(ledger.usage_ledger(calls(spark, d), prices(spark)), 30.0)
    return flags.select("day", F.round("spent", 8).alias("spent"), "over", F.round("year_to_date", 3).alias("year_to_date"))
