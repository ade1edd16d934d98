"""Catalog queries: predicates, caps, joins, work lists, health and facets."""

from pyspark.sql import functions as F

from garderobe.functions import sizes as Z
from garderobe.functions.hashing import content_hash
from garderobe.functions.text import token_and_match
from garderobe.operators import filters as P
from garderobe.operators import joins as J
from garderobe.operators import ranking as R
from garderobe.plans import facets, health
from garderobe.sources import tables as T
from workload.bindings import DAY, HOUR, NOW, sql
from workload.registry import query

FRESH = f"""(last_seen_ms >= {NOW} - {HOUR} * CASE kind WHEN 'ebay' THEN 24 WHEN 'shopify' THEN 48 ELSE 96 END)"""
JOINED = "listings JOIN attrs USING (listing_id) JOIN sources USING (source_id)"
LIVE = "removed_ms IS NULL AND coalesce(audience, 'adult') <> 'child'"


def ids(df):
    return df.select("listing_id")


@query("listings_active_adult", sql(f"SELECT listing_id FROM {JOINED} WHERE {LIVE}", "listings", "attrs", "sources"))
def _(spark, d):
    return ids(T.candidates(spark, d).filter(P.active() & P.adult()))


@query("listings_fresh_by_kind", sql(f"SELECT listing_id, kind FROM {JOINED} WHERE {FRESH}", "listings", "attrs", "sources"))
def _(spark, d):
    s = T.sources(spark, d)
    return P.within_freshness(T.listings(spark, d), s, NOW).join(s, "source_id").select("listing_id", "kind")


@query("listings_fresh_override", sql(f"SELECT listing_id FROM listings WHERE last_seen_ms >= {NOW} - 30 * {HOUR}", "listings"))
def _(spark, d):
    return ids(P.within_freshness(T.listings(spark, d), T.sources(spark, d), NOW, 30))


@query("listings_size_overlap", sql("SELECT listing_id, array_to_string(size_normalized, ',') AS sizes FROM listings "
                                    "WHERE len(size_normalized) = 0 OR list_has_any(size_normalized, [8, 10])", "listings"))
def _(spark, d):
    wanted = F.array(F.lit(8), F.lit(10))
    return T.listings(spark, d).filter(Z.size_overlap(F.col("size_normalized"), wanted)).select(
        "listing_id", F.array_join(F.col("size_normalized").cast("array<string>"), ",").alias("sizes"))


@query("listings_usd_price", sql("SELECT listing_id, currency, usd_cents FROM listings WHERE usd_cents BETWEEN 95000 AND 120000",
                                 "listings"))
def _(spark, d):
    return T.listings(spark, d).filter(P.price_between(95000, 120000)).select(
        "listing_id", "currency", P.usd_price().alias("usd_cents"))


REQUEST = P.CandidateRequest(
    sizes=[4, 8, 12, 16], price_min_cents=70000, price_max_cents=115000, conditions=["new", "good", "fair"],
    brands=["brand#1", "BRAND#12", "Brand#3", "Brand#4", "Brand#17", "Brand#22"],
    color_families=["Blue", "green", "red"], length_classes=["midi", "maxi", "mini", "knee"],
)


@query("candidates_request", sql(f"""SELECT listing_id FROM {JOINED} WHERE {LIVE} AND {FRESH}
  AND (len(size_normalized) = 0 OR list_has_any(size_normalized, [4, 8, 12, 16])) AND usd_cents BETWEEN 70000 AND 115000
  AND condition IN ('new', 'good', 'fair')
  AND lower(brand) IN ('brand#1', 'brand#12', 'brand#3', 'brand#4', 'brand#17', 'brand#22')
  AND list_has_any(families, ['blue', 'green', 'red']) AND length_class IN ('midi', 'maxi', 'mini', 'knee')""",
                                 "listings", "attrs", "sources"))
def _(spark, d):
    return ids(P.candidates(T.candidates(spark, d), T.sources(spark, d), NOW, REQUEST))


@query("candidates_text", sql(f"""SELECT listing_id FROM {JOINED} WHERE {LIVE} AND {FRESH}
  AND contains(lower(concat_ws(chr(10), title, brand, description)), 'silk')
  AND contains(lower(concat_ws(chr(10), title, brand, description)), 'in,')""", "listings", "attrs", "sources"))
def _(spark, d):
    return ids(P.candidates(T.candidates(spark, d), T.sources(spark, d), NOW, P.CandidateRequest(query=" Silk  in, ")))


@query("title_brand_text", sql("SELECT listing_id FROM listings WHERE contains(lower(title || ' ' || coalesce(brand, '')), 'red') "
                               "AND contains(lower(title || ' ' || coalesce(brand, '')), 'brand#1')", "listings"))
def _(spark, d):
    hay = F.concat(F.col("title"), F.lit(" "), F.coalesce("brand", F.lit("")))
    return ids(T.listings(spark, d).filter(token_and_match(F.lit("RED brand#1"), hay)))


@query("excluded_ids", sql("SELECT listing_id FROM listings WHERE listing_id NOT IN (SELECT listing_id FROM swipes)",
                           "listings", "swipes"))
def _(spark, d):
    return ids(P.excluding(T.listings(spark, d), T.swipes(spark, d)))


@query("source_facets", sql("SELECT source_id FROM sources WHERE regexp_matches(source_id, '(^|:)ebay\\b', 'i') "
                            "OR source_id = 'jsonld:n2'", "sources"))
def _(spark, d):
    return P.expand_sources(T.sources(spark, d), ["resale", "jsonld:n2"])


@query("enabled_sources", sql("SELECT source_id FROM sources WHERE enabled", "sources"))
def _(spark, d):
    return P.enabled_sources(T.sources(spark, d))


@query("placeholder_images", sql("""SELECT listing_id, url LIKE 'https://placehold.co/%' AS placeholder FROM
  (SELECT listing_id, unnest(image_urls) AS url FROM listings)""", "listings"))
def _(spark, d):
    return T.listing_images(spark, d).select("listing_id", P.placeholder_image(F.col("url")).alias("placeholder"))


@query("size_labels_normalized", sql("SELECT listing_id, array_to_string(size_labels, ',') AS labels, "
                                     "array_to_string(size_normalized, ',') AS sizes FROM listings", "listings"))
def _(spark, d):
    return T.listings(spark, d).select("listing_id", F.array_join("size_labels", ",").alias("labels"),
                                       F.array_join(F.col("size_normalized").cast("array<string>"), ",").alias("sizes"))


@query("content_hashes", sql("SELECT listing_id, content_hash FROM listings", "listings"))
def _(spark, d):
    hashed = content_hash(F.col("title"), F.col("description"), F.col("price_cents"), F.col("image_urls"), F.col("size_labels"))
    return T.listings(spark, d).select("listing_id", hashed.alias("content_hash"))


@query("size_verdicts", sql("""
SELECT user_id, listing_id, CASE WHEN len(sizes) = 0 OR len(size_labels) = 0 THEN 'unknown'
  WHEN NOT list_has_any(sizes, size_normalized) THEN 'not_listed'
  WHEN open THEN 'in_your_size' ELSE 'listed_sold_out' END AS verdict
FROM (SELECT u.user_id, l.*, u.sizes, EXISTS (SELECT 1 FROM lab WHERE lab.listing_id = l.listing_id
    AND list_has_any(u.sizes, lab.one) AND in_stock) AS open
  FROM users u JOIN {OWNED} l ON l.owner = u.user_id)""", "listings", "users", lab="""
SELECT listing_id, CASE WHEN lbl IN ('S') THEN [4, 6] WHEN lbl = 'M' THEN [8, 10] WHEN lbl = 'XL' THEN [16]
    WHEN lbl = '1X' THEN [16, 18] WHEN lbl = 'L+' THEN [12, 14] WHEN lbl = 'OS' THEN [] WHEN n > 26 THEN []
    WHEN n % 2 = 0 THEN [n] ELSE [n - 1, n + 1] END AS one, (listing_key + i - 1) % 3 <> 0 AS in_stock
FROM (SELECT listing_id, listing_key, i, lbl, TRY_CAST(replace(lbl, 'US ', '') AS INTEGER) AS n
  FROM (SELECT listing_id, listing_key, unnest(size_labels) AS lbl, unnest(range(1, len(size_labels) + 1)) AS i FROM listings))"""))
def _(spark, d):
    u, l = T.users(spark, d), T.listings(spark, d)
    return u.join(l, u.user_id == l.listing_key % T.key_count(spark, d, "customer", "c_custkey")).select(
        "user_id", "listing_id",
        Z.size_verdict(F.col("sizes"), F.col("size_labels"), F.col("availability")).alias("verdict"))


@query("size_compatibility", sql("""
SELECT user_id, listing_id, CASE WHEN len(sizes) = 0 THEN true ELSE coalesce(measured, CASE WHEN len(size_normalized) = 0 THEN true
  WHEN is_vintage THEN len(list_filter(size_normalized, lambda s: len(list_filter(sizes, lambda u: u >= s - 6 AND u <= s - 2)) > 0)) > 0
  ELSE list_has_any(size_normalized, sizes) END) END AS fits
FROM (SELECT u.user_id, u.sizes, l.listing_id, l.size_normalized, l.is_vintage,
    CASE WHEN bust IS NOT NULL AND body_bust IS NOT NULL THEN
      bust BETWEEN body_bust - 1 AND body_bust + ease + 2 AND waist BETWEEN body_waist - 1 AND body_waist + ease + 2 END AS measured
  FROM users u JOIN {OWNED} l ON l.owner = u.user_id JOIN
   (SELECT *, CASE coalesce(silhouette, 'other') WHEN 'bodycon' THEN 1.0 WHEN 'sheath' THEN 1.5 WHEN 'slip' THEN 1.5
      WHEN 'a_line' THEN 2.5 WHEN 'wrap' THEN 2.5 ELSE 2.0 END AS ease FROM attrs) a ON a.listing_id = l.listing_id)""",
                                 "listings", "users", "attrs"))
def _(spark, d):
    u, l = T.users(spark, d), T.candidates(spark, d)
    fits = Z.size_compatible(F.col("size_normalized"), F.col("is_vintage"), F.col("measurements"), F.col("silhouette"),
                             F.col("sizes"), F.col("body"))
    return u.join(l, u.user_id == l.listing_key % T.key_count(spark, d, "customer", "c_custkey")).select("user_id", "listing_id", fits.alias("fits"))


# --- ordering and caps -----------------------------------------------------------------------------------------
@query("newest_first", sql("SELECT listing_id FROM listings ORDER BY last_seen_ms DESC, listing_id LIMIT 500", "listings"))
def _(spark, d):
    return ids(R.newest_first(T.listings(spark, d)))


CAPPED = """SELECT listing_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY rb, last_seen_ms DESC, listing_id)
  AS rs FROM (SELECT *, row_number() OVER (PARTITION BY source_id, lower(trim(coalesce(brand, ''))) ORDER BY last_seen_ms DESC,
    listing_id) AS rb FROM listings WHERE removed_ms IS NULL)) ORDER BY rs, last_seen_ms DESC, listing_id LIMIT {cap}"""


@query("stratified_cap", sql(CAPPED.format(cap=500), "listings"))
def _(spark, d):
    return ids(R.stratified_cap(T.listings(spark, d).filter(P.active())))


@query("stratified_cap_40", sql(CAPPED.format(cap=40), "listings"))
def _(spark, d):
    return ids(R.stratified_cap(T.listings(spark, d).filter(P.active()), cap=40))


@query("verification_oldest", sql("""SELECT listing_id FROM listings WHERE removed_ms IS NULL
  AND (source_id LIKE 'shopify:%' OR source_id LIKE 'jsonld:%')
  ORDER BY coalesce(verified_ms, 0), last_seen_ms, listing_id LIMIT 50""", "listings"))
def _(spark, d):
    from garderobe.plans.verify import oldest_verified
    return ids(oldest_verified(T.listings(spark, d), 50))


# --- joins and work lists --------------------------------------------------------------------------------------
def aged(spark, d):
    """Extractions plus an outdated row for every third listing (an older hash that lingers)."""
    now = T.extractions(spark, d)
    old = now.filter(F.substring("listing_id", 2, 20).cast("long") % 3 == 0).withColumns({
        "content_hash": F.concat(F.lit("old-"), "listing_id"), "extracted_ms": F.col("extracted_ms") - DAY,
        "length_class": F.lit("micro"),
    })
    return now.unionByName(old)


@query("listing_extraction", sql("SELECT listing_id, source_id, extraction_hash, length_class FROM listings LEFT JOIN "
                                 "(SELECT listing_id, content_hash AS extraction_hash, length_class FROM attrs) USING (listing_id)",
                                 "listings", "attrs"))
def _(spark, d):
    return J.with_extraction(T.listings(spark, d), aged(spark, d)).select(
        "listing_id", "source_id", "extraction_hash", "length_class")


@query("current_vectors", sql("SELECT l.listing_id, round(list_sum(v.vector::DOUBLE[]), 4) AS total FROM vectors v JOIN listings l ON l.listing_id = v.listing_id "
                              "AND l.content_hash = v.content_hash WHERE removed_ms IS NULL", "listings", "vectors"))
def _(spark, d):
    l = T.listings(spark, d)
    total = F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return J.with_vectors(l, T.embeddings(spark, d, l), T.MODEL).select("listing_id", F.round(total, 4).alias("total"))


@query("extraction_qa", sql("""SELECT listing_id, model, confidence, image_url FROM (
  SELECT a.listing_id, a.model, round(confidence, 6) AS confidence, extracted_ms, a.content_hash, image_urls[1] AS image_url
  FROM attrs a JOIN listings USING (listing_id) WHERE confidence <= 0.3 AND length_inches IS NULL)
  ORDER BY confidence NULLS FIRST, extracted_ms DESC, content_hash LIMIT 50 OFFSET 10""", "listings", "attrs"))
def _(spark, d):
    from garderobe.plans.extract import qa_list
    l = T.listings(spark, d)
    out = qa_list(T.extractions(spark, d, l), l, T.listing_images(spark, d), max_confidence=0.3, missing_length=True,
                  limit=50, offset=10)
    return out.select("listing_id", "model", F.round("confidence", 6).alias("confidence"), "image_url")


@query("length_estimate_queue", sql("""SELECT a.listing_id, image_urls[1] AS image_url FROM attrs a JOIN listings USING (listing_id)
  WHERE removed_ms IS NULL AND len(image_urls) > 0 AND length_inches IS NULL AND length_basis IS NULL AND model <> 'manual'""",
                                    "listings", "attrs"))
def _(spark, d):
    l = T.listings(spark, d)
    return J.estimate_queue(J.length_targets(T.extractions(spark, d, l), l, T.listing_images(spark, d))).select(
        "listing_id", "image_url")


PARTLY = "substring(content_hash, 1, 1) < '8'"


@query("pending_extractions", sql(f"""SELECT listing_id, image_urls[1] AS image_url FROM listings JOIN sources USING (source_id)
  WHERE removed_ms IS NULL AND enabled AND content_hash NOT IN (SELECT content_hash FROM attrs WHERE {PARTLY})
  AND NOT EXISTS (SELECT 1 FROM attrs a WHERE a.listing_id = listings.listing_id AND model = 'manual' AND {PARTLY})""",
                                  "listings", "attrs", "sources"))
def _(spark, d):
    l = T.listings(spark, d)
    have = T.extractions(spark, d, l).filter(F.substring("content_hash", 1, 1) < "8")
    return J.pending_extractions(l, have, T.listing_images(spark, d), P.enabled_sources(T.sources(spark, d))).select(
        "listing_id", "image_url")


@query("missing_vectors", sql("""SELECT listing_id, image_urls[1] AS image_url FROM listings WHERE removed_ms IS NULL
  AND len(image_urls) > 0 AND content_hash NOT IN (SELECT content_hash FROM vectors)
  ORDER BY last_seen_ms DESC, listing_id LIMIT 200""", "listings", "vectors"))
def _(spark, d):
    l = T.listings(spark, d)
    todo = J.missing_vectors(l, T.listing_images(spark, d), T.embeddings(spark, d, l), T.MODEL)
    return J.newest_queue(todo, 200).select("listing_id", "image_url")


@query("mock_rows_dropped", sql("""SELECT model, count(*) AS n FROM attrs WHERE NOT (model = 'mock' AND listing_id IN
  (SELECT listing_id FROM listings JOIN sources USING (source_id) WHERE kind = 'ebay')) GROUP BY model""",
                                "listings", "attrs", "sources"))
def _(spark, d):
    l = T.listings(spark, d)
    ebay = T.sources(spark, d).filter(F.col("kind") == "ebay").select("source_id")
    return J.drop_mock(T.extractions(spark, d, l), l, ebay).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query("first_image", sql("SELECT listing_id, image_urls[1] AS image_url FROM listings WHERE len(image_urls) > 0", "listings"))
def _(spark, d):
    return J.first_images(T.listing_images(spark, d))


@query("ordered_hydration", sql("""SELECT swipe_id AS ordinal, listing_id, title FROM swipes JOIN listings USING (listing_id)""",
                                "swipes", "listings"))
def _(spark, d):
    wanted = T.swipes(spark, d).select(F.col("swipe_id").alias("ordinal"), "listing_id")
    return J.in_order(wanted, T.listings(spark, d)).select("ordinal", "listing_id", "title")


@query("listings_with_images", sql("SELECT listing_id, array_to_string(image_urls, ' ') AS images FROM listings", "listings"))
def _(spark, d):
    return J.hydrated(T.listings(spark, d), T.listing_images(spark, d)).select(
        "listing_id", F.array_join("image_urls", " ").alias("images"))


@query("known_swipes", sql("SELECT swipe_id, listing_id FROM swipes WHERE listing_id IN (SELECT listing_id FROM listings)",
                           "swipes", "listings"))
def _(spark, d):
    return J.known_swipes(T.swipes(spark, d), T.listings(spark, d)).select("swipe_id", "listing_id")


@query("clickouts", sql("SELECT click_id, user_id, source_id, sha256(coalesce(affiliate_url, source_url)) AS destination_hash "
                        "FROM clicks JOIN listings USING (listing_id)", "clicks", "listings"))
def _(spark, d):
    return J.clickouts(T.clicks(spark, d), T.listings(spark, d)).select("click_id", "user_id", "source_id", "destination_hash")


@query("clickout_stats", sql(f"""SELECT source_id, count(*) AS total, count(*) FILTER (created_ms >= 1706659200000 - {DAY})
  AS last_24h FROM clicks JOIN listings USING (listing_id) GROUP BY ROLLUP (source_id)""", "clicks", "listings"))
def _(spark, d):
    return health.clickout_stats(J.clickouts(T.clicks(spark, d), T.listings(spark, d)), T.EVENTS_NOW_MS)


@query("url_in_catalog", sql("""SELECT url, listing_id AS found_id, listing_id IS NOT NULL AS in_catalog FROM
  (SELECT DISTINCT 'https://store' || s_nationkey || '.example.com/products/' || s_suppkey || '?utm_source=feed&variant=2' AS url
   FROM supplier) LEFT JOIN listings ON source_url = url""", "listings"))
def _(spark, d):
    s = T.read(spark, d, "supplier")
    urls = s.select(F.concat(F.lit("https://store"), F.col("s_nationkey").cast("string"), F.lit(".example.com/products/"),
                             F.col("s_suppkey").cast("string"), F.lit("?utm_source=feed&variant=2")).alias("url")).distinct()
    return J.already_listed(urls, T.listings(spark, d)).select("url", "found_id", "in_catalog")


# --- health ----------------------------------------------------------------------------------------------------
@query("source_last_ok", sql("SELECT source_id, max(started_ms) AS last_ok_ms FROM runs JOIN sources USING (source_id) "
                             "WHERE enabled AND status = 'ok' GROUP BY source_id", "runs", "sources"))
def _(spark, d):
    return J.ok_runs(T.ingest_runs(spark, d), T.sources(spark, d))


LAST_RUN = """SELECT source_id, run_id, started_ms, status, fetched FROM (SELECT *, row_number() OVER (PARTITION BY source_id
  ORDER BY started_ms DESC, run_id DESC) AS rn FROM runs) WHERE rn = 1"""


@query("latest_runs", sql(LAST_RUN, "runs"))
def _(spark, d):
    return health.latest_runs(T.ingest_runs(spark, d)).select(
        "source_id", "run_id", "started_ms", "status", F.get_json_object("stats", "$.fetched").cast("long").alias("fetched"))


@query("source_health", sql(f"""SELECT s.*, coalesce(total, 0) AS total, coalesce(active, 0) AS active,
  coalesce(total, 0) - coalesce(active, 0) AS removed, coalesce(fresh_24h, 0) AS fresh_24h, coalesce(fresh_48h, 0) AS fresh_48h,
  coalesce(stale_48h, 0) AS stale_48h, coalesce(error_runs, 0) AS error_runs, run_id AS last_run_id,
  started_ms AS last_started_ms, status AS last_status, coalesce(fetched, 0) AS last_fetched
FROM sources s LEFT JOIN (SELECT source_id, count(*) AS total, count(*) FILTER (removed_ms IS NULL) AS active,
    count(*) FILTER (removed_ms IS NULL AND last_seen_ms >= {NOW} - 24 * {HOUR}) AS fresh_24h,
    count(*) FILTER (removed_ms IS NULL AND last_seen_ms >= {NOW} - 48 * {HOUR}) AS fresh_48h,
    count(*) FILTER (removed_ms IS NULL AND last_seen_ms <= {NOW} - 48 * {HOUR}) AS stale_48h
  FROM listings GROUP BY source_id) USING (source_id)
LEFT JOIN (SELECT source_id, count(*) FILTER (status = 'error') AS error_runs FROM runs GROUP BY source_id) USING (source_id)
LEFT JOIN last_run USING (source_id)""", "sources", "listings", "runs", last_run=LAST_RUN))
def _(spark, d):
    return health.source_health(T.sources(spark, d), T.listings(spark, d), T.ingest_runs(spark, d), NOW)


@query("catalog_overview", sql("""SELECT total, active, vector_rows, embedded_listings, extracted,
  floor(100.0::DOUBLE * c / active * 10 + 0.5) / 10 AS length_class_pct, floor(100.0::DOUBLE * i / active * 10 + 0.5) / 10
  AS length_inches_pct, floor(100.0::DOUBLE * k / active * 10 + 0.5) / 10 AS colors_pct FROM
  (SELECT count(*) AS total, count(*) FILTER (removed_ms IS NULL) AS active FROM listings),
  (SELECT count(*) AS vector_rows, count(DISTINCT v.listing_id) FILTER (removed_ms IS NULL) AS embedded_listings
   FROM vectors v JOIN listings USING (listing_id)),
  (SELECT count(DISTINCT listing_id) AS extracted, count(DISTINCT listing_id) FILTER (length_class IS NOT NULL) AS c,
    count(DISTINCT listing_id) FILTER (length_inches IS NOT NULL) AS i, count(DISTINCT listing_id) FILTER (len(families) > 0) AS k
   FROM attrs JOIN listings USING (listing_id) WHERE removed_ms IS NULL)""", "listings", "vectors", "attrs"))
def _(spark, d):
    l = T.listings(spark, d)
    return health.overview(l, T.extractions(spark, d, l), T.embeddings(spark, d, l))


@query("length_coverage", sql("""SELECT count(*) AS live, count(length_inches) AS with_inches, count(length_inches) AS stated,
  0 AS image_estimated, 0 AS anchored, 0 AS not_estimable, count(length_class) AS with_class
FROM listings JOIN attrs USING (listing_id) WHERE removed_ms IS NULL""", "listings", "attrs"))
def _(spark, d):
    l = T.listings(spark, d)
    return health.length_coverage(l, T.extractions(spark, d, l))


@query("embedding_stats", sql("""SELECT count(*) AS n, coalesce(max(embedded_ms), 0) AS last_embedded_ms FROM vectors v
  JOIN listings l ON l.listing_id = v.listing_id AND l.content_hash = v.content_hash WHERE removed_ms IS NULL""",
                              "vectors", "listings"))
def _(spark, d):
    l = T.listings(spark, d)
    return health.embedding_stats(l, T.embeddings(spark, d, l), T.MODEL)


@query("stalest_source", sql(f"""SELECT source_id, last_ok AS last_ok_ms, CAST(floor(({NOW} - last_ok) / {HOUR}::DOUBLE + 0.5) AS BIGINT)
  AS age_hours, {NOW} - last_ok > 30 * {HOUR} AS alert FROM (SELECT source_id, max(started_ms) AS last_ok FROM runs
  JOIN sources USING (source_id) WHERE enabled AND status = 'ok' GROUP BY source_id) ORDER BY last_ok, source_id LIMIT 1""",
                             "runs", "sources"))
def _(spark, d):
    return health.stalest_source(T.ingest_runs(spark, d), T.sources(spark, d), NOW)


@query("facets", sql("""SELECT DISTINCT 'brand' AS facet, brand AS value FROM listings WHERE removed_ms IS NULL AND brand IS NOT NULL
UNION ALL SELECT DISTINCT 'color', f FROM (SELECT unnest(families) AS f FROM attrs JOIN listings USING (listing_id)
  WHERE removed_ms IS NULL)
UNION ALL SELECT 'price_min', CAST(min(usd_cents) AS VARCHAR) FROM listings WHERE removed_ms IS NULL
UNION ALL SELECT 'price_max', CAST(max(usd_cents) AS VARCHAR) FROM listings WHERE removed_ms IS NULL""", "listings", "attrs"))
def _(spark, d):
    l = T.listings(spark, d)
    return facets.facets(l, T.extractions(spark, d, l))


@query("extracted_attributes", sql("""SELECT listing_id, length_class, length_inches, array_to_string(families, ',') AS families,
  fabric, neckline, silhouette, pattern, occasion AS occasions, audience, bust, waist, round(confidence, 6) AS confidence FROM attrs""",
                                   "attrs"))
def _(spark, d):
    return T.extractions(spark, d).select(
        "listing_id", "length_class", "length_inches",
        F.array_join(F.transform("colors", lambda c: c["family"]), ",").alias("families"), "fabric", "neckline", "silhouette",
        "pattern", F.nullif(F.array_join("occasions", ","), F.lit("")).alias("occasions"), "audience",
        F.col("measurements.bust").alias("bust"), F.col("measurements.waist").alias("waist"),
        F.round("confidence", 6).alias("confidence"))


@query("attribute_vectors", sql("SELECT listing_id, tag, w FROM tags", "tags"))
def _(spark, d):
    return T.extractions(spark, d).select("listing_id", F.explode("attribute_vector").alias("tag", "w"))
