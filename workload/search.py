"""Search interpretation and hybrid search."""

from pyspark.sql import functions as F

from garderobe.functions.interpret import interpret, merge_parse
from garderobe.operators.filters import active
from garderobe.plans import feed, search
from garderobe.session import stage
from garderobe.sources import tables as T
from workload.bindings import NOW, pick, sql
from workload.registry import query
from workload.ranking import LIVE, POOLS

SHAPES = ["wrap", "slip", "a-line", "bodycon", None]
SHAPE_VALUES = ["wrap", "slip", "a_line", "bodycon", None]
LENGTHS = ["mini", "midi", "evening gown", None]
EXTRA = ["sundress", "wedding guest", None, "boho"]


def texts(spark, d):
    """One search string per part, from its name, brand, size and key."""
    k = "p_partkey"
    return T.read(spark, d, "part").selectExpr(
        f"{k} as query_id", "p_name", "p_brand",
        f"concat_ws(' ', p_name, {T.pick(SHAPES, f'{k} % 5')}, {T.pick(LENGTHS, f'{k} % 4')}, {T.pick(EXTRA, f'{k} div 4 % 4')}, "
        f"case {k} % 6 when 0 then concat('under $', 900 + {k} % 90) when 1 then concat('$', 950 + {k} % 9, '-', 900 + {k} % 9) when 2 then concat('over ', 930 + {k} % 20, ' dollars') end, "
        f"if({k} % 7 < 2, concat('Size ', p_size), null), if({k} % 9 = 0, p_brand, null), 'for the') as text")


PARSED = f"""SELECT p_partkey AS query_id, CASE p_partkey % 6 WHEN 1 THEN 100 * (900 + p_partkey % 9) WHEN 2 THEN 100 * (930 + p_partkey % 20) END AS price_min_cents,
  CASE p_partkey % 6 WHEN 0 THEN 100 * (900 + p_partkey % 90) WHEN 1 THEN 100 * (950 + p_partkey % 9) END AS price_max_cents,
  CASE WHEN p_partkey % 7 < 2 AND p_size <= 26 THEN CAST(p_size AS VARCHAR) ELSE '' END AS sizes,
  CASE WHEN p_partkey % 9 = 0 AND p_brand IN (SELECT brand FROM listings WHERE removed_ms IS NULL) THEN p_brand ELSE '' END AS brands,
  CASE p_partkey % 4 WHEN 0 THEN 'mini' WHEN 1 THEN 'midi' WHEN 2 THEN 'maxi,floor' ELSE '' END AS length_classes,
  array_to_string(list_filter([CASE WHEN p_partkey % 4 = 2 THEN 'formal' END] || CASE p_partkey // 4 % 4 WHEN 0 THEN ['casual', 'vacation'] WHEN 1 THEN ['wedding_guest'] ELSE [] END,
    lambda x: x IS NOT NULL), ',') AS occasions,
  CASE split_part(p_name, ' ', 1) WHEN 'red' THEN 'red' WHEN 'blue' THEN 'blue' ELSE '' END AS colors,
  array_to_string(list_filter([CASE WHEN p_partkey // 4 % 4 = 3 THEN 'tent' END, {pick(SHAPE_VALUES, 'p_partkey % 5')}], lambda x: x IS NOT NULL), ',') AS silhouettes,
  CASE WHEN p_partkey // 4 % 4 = 3 THEN 'floral' ELSE '' END AS patterns,
  array_to_string(list_filter([CASE WHEN split_part(p_name, ' ', 1) NOT IN ('red', 'blue') THEN split_part(p_name, ' ', 1) END, split_part(p_name, ' ', 2),
    CASE p_partkey // 4 % 4 WHEN 0 THEN 'sundress' WHEN 3 THEN 'boho' END], lambda x: x IS NOT NULL), ',') AS residual FROM part"""


@query("search_interpreted", sql("SELECT * FROM parsed", "listings", parsed=PARSED))
def _(spark, d):
    brands = T.listings(spark, d).filter(active() & F.col("brand").isNotNull()).select("brand")
    p = interpret(texts(spark, d).select("query_id", "text"), brands)
    flat = ["brands", "length_classes", "occasions", "colors", "silhouettes", "patterns", "residual"]
    return p.select("query_id", "price_min_cents", "price_max_cents", F.array_join(F.col("sizes").cast("array<string>"), ",").alias("sizes"),
                    *[F.array_join(c, ",").alias(c) for c in flat])


SIGNALS = """SELECT p_partkey AS query_id, array_to_string(list_filter([
    CASE p_partkey % 6 WHEN 0 THEN 'price|under $' || (900 + p_partkey % 90) || '|under $' || (900 + p_partkey % 90) || '|true'
      WHEN 1 THEN 'price|$' || (950 + p_partkey % 9) || '-' || (900 + p_partkey % 9) || '|$' || (900 + p_partkey % 9) || '–$' || (950 + p_partkey % 9) || '|true'
      WHEN 2 THEN 'price|over ' || (930 + p_partkey % 20) || ' dollars|over $' || (930 + p_partkey % 20) || '|true' END,
    CASE WHEN p_partkey % 7 < 2 AND p_size <= 26 THEN 'size|Size ' || p_size || '|size ' || p_size || '|true' END,
    CASE WHEN p_partkey % 9 = 0 AND p_brand IN (SELECT brand FROM listings WHERE removed_ms IS NULL) THEN 'brand|' || p_brand || '|' || p_brand || '|true' END]
    || CASE p_partkey % 4 WHEN 0 THEN ['length|mini|mini|true'] WHEN 1 THEN ['length|midi|midi|true']
      WHEN 2 THEN ['length|evening gown|maxi|true', 'length|evening gown|floor|true', 'occasion|evening gown|formal|false'] ELSE [] END
    || CASE p_partkey // 4 % 4 WHEN 0 THEN ['occasion|sundress|casual|false', 'occasion|sundress|vacation|false']
      WHEN 3 THEN ['pattern|boho|floral|false', 'silhouette|boho|tent|false'] ELSE [] END
    || [{shape}, CASE WHEN split_part(p_name, ' ', 1) IN ('red', 'blue') THEN 'color|' || split_part(p_name, ' ', 1) || '|' || split_part(p_name, ' ', 1) || '|false' END,
      CASE p_partkey // 4 % 4 WHEN 1 THEN 'occasion|wedding guest|wedding_guest|false' END], lambda x: x IS NOT NULL), ';') AS signals FROM part""".format(
    shape=pick([s and f"silhouette|{s}|{v}|false" for s, v in zip(SHAPES, SHAPE_VALUES)], "p_partkey % 5"))


def listed(signals):
    """Signals as one text, in order."""
    return F.array_join(F.transform(signals, lambda s: F.concat_ws("|", s["kind"], s["term"], s["value"], s["hard"].cast("string"))), ";")


@query("search_signals", sql("SELECT * FROM s", "listings", s=SIGNALS))
def _(spark, d):
    brands = T.listings(spark, d).filter(active() & F.col("brand").isNotNull()).select("brand")
    return interpret(texts(spark, d).select("query_id", "text"), brands).select("query_id", listed(F.col("signals")).alias("signals"))


# What the searcher took back: the price, color or brand that the other parse would bring, or nothing.
GONE = ["over $123", " GREEN ", "brand#7", None]


@query("search_parse_merged", sql("""SELECT query_id, coalesce(price_min_cents, CASE WHEN price_max_cents IS NULL AND NOT no_price THEN 12300 END) AS price_min_cents, price_max_cents,
  brand AS brands, CASE WHEN no_green THEN colors WHEN colors IN ('', 'green') THEN 'green' ELSE colors || ',green' END AS colors,
  (price_min_cents IS NULL AND price_max_cents IS NULL AND NOT no_price)::INT + (brand <> '' AND own = '')::INT + (NOT no_green)::INT AS added
  FROM (SELECT *, CASE WHEN own <> '' THEN own WHEN no_brand THEN '' ELSE 'Brand#7' END AS brand FROM
  (SELECT *, query_id % 4 = 0 AS no_price, query_id % 4 = 1 AS no_green, query_id % 4 = 2 AS no_brand,
    CASE WHEN query_id % 4 = 2 AND brands = 'Brand#7' THEN '' ELSE brands END AS own FROM parsed))""", "listings", parsed=PARSED))
def _(spark, d):
    brands = T.listings(spark, d).filter(active() & F.col("brand").isNotNull()).select("brand")
    p = interpret(texts(spark, d).selectExpr("query_id", "text", f"array_compact(array({T.pick(GONE, 'query_id % 4')})) as lexical_terms"), brands)
    none = "cast(array() as array<string>)"
    other = texts(spark, d).selectExpr("query_id", "12300L as price_min_cents", "cast(null as bigint) as price_max_cents", "cast(array() as array<int>) as sizes",
                                       f"{none} as length_classes", "array('brand#7', 'nobody') as brands", f"{none} as occasions", "array('Green') as colors",
                                       f"{none} as fabrics", f"{none} as silhouettes", "'airy' as vibe_text")
    both = merge_parse(p.withColumn("_n", F.size("signals")), other, brands)
    return both.select("query_id", "price_min_cents", "price_max_cents", F.array_join("brands", ",").alias("brands"),
                       F.array_join("colors", ",").alias("colors"), (F.size("signals") - F.col("_n")).alias("added"))


def asked(spark, d):
    """Every search text, asked by the user with its key modulo the number of users."""
    users = T.users(spark, d)
    return texts(spark, d).select("query_id", "text").withColumn("user_id", F.col("query_id") % T.key_count(spark, d, "customer", "c_custkey")), users


QPOOL = """SELECT query_id, count(*) AS n FROM (SELECT query_id, listing_id FROM q JOIN live l ON (q.lo IS NULL OR usd_cents >= q.lo) AND (q.hi IS NULL OR usd_cents <= q.hi)
  AND (q.size = '' OR len(size_normalized) = 0 OR list_contains(size_normalized, TRY_CAST(q.size AS INTEGER))) AND (q.brand = '' OR lower(l.brand) = lower(q.brand))
  JOIN attrs a USING (listing_id) WHERE q.lens = '' OR list_contains(string_split(q.lens, ','), a.length_class)) GROUP BY query_id"""


@query("search_pools", sql("SELECT query_id, least(n, 500) AS n FROM qp", "listings", "attrs", "sources", live=LIVE, parsed=PARSED,
                           q="SELECT query_id, price_min_cents AS lo, price_max_cents AS hi, sizes AS size, brands AS brand, length_classes AS lens FROM parsed", qp=QPOOL))
def _(spark, d):
    q, _ = asked(spark, d)
    catalog = T.candidates(spark, d)
    live = feed.live_catalog(catalog, T.sources(spark, d), NOW)
    return search.query_pools(search.plan_queries(q, catalog), live).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


SEARCH_POOL = dict(live=LIVE, parsed=PARSED, matched="""SELECT query_id AS profile, listing_id, l.source_id, l.brand, l.last_seen_ms FROM
  (SELECT query_id, price_min_cents AS lo, price_max_cents AS hi, sizes AS size, brands AS brand, length_classes AS lens FROM parsed) q
  JOIN live l ON (q.lo IS NULL OR usd_cents >= q.lo) AND (q.hi IS NULL OR usd_cents <= q.hi)
  AND (q.size = '' OR len(size_normalized) = 0 OR list_contains(size_normalized, TRY_CAST(q.size AS INTEGER))) AND (q.brand = '' OR lower(l.brand) = lower(q.brand))
  JOIN attrs a USING (listing_id) WHERE q.lens = '' OR list_contains(string_split(q.lens, ','), a.length_class)""", pool=POOLS.format(cap=500))
# Parts of the relevance of a pool row: tags found of those wanted, words found of those left, and the place of its vector in the pool.
RELEVANCE = """SELECT query_id, listing_id, CASE WHEN tagged > 0 OR worded > 0 OR semantic THEN (0.5::DOUBLE * coalesce(attr, 0) + 0.3::DOUBLE * coalesce(sem, 0) + 0.2::DOUBLE * coalesce(lex, 0))
  / nullif(0.5::DOUBLE * (attr IS NOT NULL)::INT + 0.3::DOUBLE * (sem IS NOT NULL)::INT + 0.2::DOUBLE * (lex IS NOT NULL)::INT, 0) END AS relevance
  FROM (SELECT *, CASE WHEN raw IS NOT NULL THEN CASE WHEN top = low THEN 0.5::DOUBLE ELSE (raw - low) / (top - low) END END AS sem FROM
  (SELECT p.profile AS query_id, p.listing_id, coalesce(n_tags, 0) AS tagged, coalesce(n_words, 0) AS worded, n_hit::DOUBLE / n_tags AS attr, n_said::DOUBLE / n_words AS lex, raw,
    min(raw) OVER w AS low, max(raw) OVER w AS top, s.vec_id IS NOT NULL AS semantic, row_number() OVER (w ORDER BY raw DESC NULLS LAST, p.listing_id) AS near
   FROM pool p LEFT JOIN tagged t USING (profile, listing_id) LEFT JOIN said d USING (profile, listing_id) LEFT JOIN raws r USING (profile, listing_id)
   LEFT JOIN embeddings s ON s.vec_id = p.profile WINDOW w AS (PARTITION BY p.profile)))
  WHERE (tagged = 0 AND worded = 0 AND NOT semantic) OR coalesce(attr, 0) > 0 OR coalesce(lex, 0) > 0 OR (raw IS NOT NULL AND near <= 50)"""
RELEVANCE_PARTS = dict(
    wanted="""SELECT query_id, unnest(list_filter(list_transform(string_split(occasions, ','), lambda x: 'occasion:' || x) || list_transform(string_split(colors, ','), lambda x: 'color:' || x)
      || list_transform(string_split(silhouettes, ','), lambda x: 'silhouette:' || x) || list_transform(string_split(patterns, ','), lambda x: 'pattern:' || x),
      lambda x: NOT ends_with(x, ':'))) AS tag FROM parsed""",
    tagged="""SELECT profile, p.listing_id, count(*) AS n_tags, count(t.tag) AS n_hit FROM pool p JOIN wanted w ON w.query_id = p.profile
      LEFT JOIN tags t ON t.listing_id = p.listing_id AND t.tag = w.tag GROUP BY ALL""",
    said="""SELECT profile, p.listing_id, count(*) AS n_words, count(*) FILTER (contains(lower(title || ' ' || coalesce(brand, '') || ' ' || coalesce(description, '')), word)) AS n_said
      FROM (SELECT profile, listing_id FROM pool) p JOIN (SELECT query_id, unnest(string_split(residual, ',')) AS word FROM parsed WHERE residual <> '') w ON w.query_id = p.profile
      JOIN listings l ON l.listing_id = p.listing_id GROUP BY ALL""",
    raws="""SELECT profile, p.listing_id, round((list_cosine_similarity(q.embedding::DOUBLE[], v.vector::DOUBLE[]) + 1) / 2, 9) AS raw
      FROM pool p JOIN embeddings q ON q.vec_id = p.profile JOIN vectors v ON v.listing_id = p.listing_id""", found=RELEVANCE)


def text_vectors(spark, d):
    return T.read(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query("search_relevance", sql("SELECT query_id, listing_id, round(relevance, 6) AS relevance FROM found", "listings", "attrs", "sources", "tags", "vectors",
                               **SEARCH_POOL, **RELEVANCE_PARTS))
def _(spark, d):
    q, _ = asked(spark, d)
    catalog = T.candidates(spark, d)
    live = feed.live_catalog(catalog, T.sources(spark, d), NOW)
    plans = stage(search.plan_queries(q, catalog), "search-plans")
    queries, listings = text_vectors(spark, d), T.embeddings(spark, d)
    sides = search.query_side(plans, queries), search.listing_side(plans, live, listings)
    found = search.relevance(plans, search.query_pools(plans, live, asked=sides[0], shown=sides[1]), live, queries, listings)
    return found.select("query_id", "listing_id", F.round("relevance", 6).alias("relevance"))


@query("batch_search")
def _(spark, d):
    q, users = asked(spark, d)
    vectors = T.embeddings(spark, d)
    qv = text_vectors(spark, d)
    out = search.batch_search(q, users, T.candidates(spark, d), T.sources(spark, d), NOW, query_vectors=qv, vectors=vectors)
    return out.select("query_id", "position", "listing_id", F.round("score", 6).alias("score"), F.round("relevance", 6).alias("relevance"))
