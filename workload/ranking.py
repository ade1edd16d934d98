"""Hem, scores, feeds, neighbours and taste."""

from pyspark.sql import functions as F

from garderobe.functions import hem as H
from garderobe.functions import scoring as S
from garderobe.functions import vectors as X
from garderobe.functions.hashing import set_fingerprint
from garderobe.functions.reasons import templated_reason
from garderobe.operators import filters as P
from garderobe.operators.diversity import spread_report
from garderobe.operators.ranking import top_n
from garderobe.plans import feed, rack, similar, taste
from garderobe.sources import tables as T
from workload.bindings import HOUR, NOW, OWNED, sql
from workload.registry import query

PRIOR = ("CASE length_class WHEN 'micro' THEN 30 WHEN 'mini' THEN 33 WHEN 'above_knee' THEN 36 WHEN 'knee' THEN 39 "
         "WHEN 'midi' THEN 44 WHEN 'mid_calf' THEN 47 WHEN 'maxi' THEN 55 WHEN 'floor' THEN 60 END::DOUBLE")


def hem_sql(pairs):
    return f"""SELECT *, CASE WHEN r IS NULL THEN NULL WHEN r > 0.42 THEN 'upper_thigh' WHEN r > 0.31 THEN 'above_knee'
  WHEN r > 0.26 THEN 'knee' WHEN r > 0.2 THEN 'below_knee' WHEN r > 0.12 THEN 'mid_calf' WHEN r > 0.03 THEN 'ankle' ELSE 'floor' END
  AS position, CASE WHEN r IS NULL THEN 'none' WHEN length_inches IS NOT NULL THEN 'measured_length' ELSE 'length_class_prior' END
  AS basis, CASE WHEN r IS NULL THEN 'low' WHEN length_inches IS NOT NULL THEN 'high' ELSE 'medium' END AS hem_confidence
FROM (SELECT *, above / eff AS r FROM (SELECT *, 0.82::DOUBLE * eff - coalesce(length_inches, {PRIOR}) AS above FROM
  (SELECT *, height_inches + heel_inches * 0.85::DOUBLE AS eff FROM ({pairs}))))"""


PAIRS = f"SELECT u.*, a.* FROM users u JOIN {OWNED} l ON l.owner = u.user_id JOIN attrs a ON a.listing_id = l.listing_id"


def own_pairs(spark, d):
    """Each listing with a user, by its key modulo the number of users: every listing once, every user if there are listings enough."""
    u, c = T.users(spark, d), T.candidates(spark, d)
    return u.join(c, u.user_id == c.listing_key % T.key_count(spark, d, "customer", "c_custkey"))


@query("hem_positions", sql("SELECT user_id, listing_id, position, floor(above * 100 + 0.5) / 100 AS above_floor, basis, "
                            "hem_confidence AS confidence FROM hems", "users", "listings", "attrs", hems=hem_sql(PAIRS)))
def _(spark, d):
    h = H.hem(F.col("length_inches"), F.col("length_class"), F.col("height_inches"), F.col("heel_inches"), F.col("length_basis"))
    return own_pairs(spark, d).select("user_id", "listing_id", h.alias("h")).select("user_id", "listing_id", "h.*")


@query("hem_filter", sql("SELECT user_id, listing_id FROM hems WHERE len(length_prefs) = 0 OR "
                         "list_contains(length_prefs, position)", "users", "listings", "attrs", hems=hem_sql(PAIRS)))
def _(spark, d):
    h = H.hem(F.col("length_inches"), F.col("length_class"), F.col("height_inches"), F.col("heel_inches"))
    return own_pairs(spark, d).withColumn("h", h).filter(
        H.hem_allowed(F.col("h.position"), F.col("length_prefs"))).select("user_id", "listing_id")


@query("adjacent_hem_bands", sql("""SELECT user_id, listing_id, array_to_string(list_filter([
  (bands)[idx - 1], (bands)[idx], (bands)[idx + 1]], lambda x: x IS NOT NULL), ',') AS bands FROM (SELECT *, list_position(bands, position) AS idx
  FROM (SELECT *, ['upper_thigh', 'above_knee', 'knee', 'below_knee', 'mid_calf', 'ankle', 'floor'] AS bands FROM hems
  WHERE position IS NOT NULL))""".replace("(bands)[idx - 1]", "CASE WHEN idx > 1 THEN bands[idx - 1] END"),
                                 "users", "listings", "attrs", hems=hem_sql(PAIRS)))
def _(spark, d):
    h = H.hem(F.col("length_inches"), F.col("length_class"), F.col("height_inches"), F.col("heel_inches"))
    near = H.adjacent_positions(F.col("h.position"))
    return own_pairs(spark, d).withColumn("h", h).filter("h.position is not null").select(
        "user_id", "listing_id", F.array_join(near, ",").alias("bands"))


@query("length_class_from_inches", sql("""SELECT p_partkey, CASE WHEN x < 31.5 THEN 'micro' WHEN x < 34.5 THEN 'mini'
  WHEN x < 37.5 THEN 'above_knee' WHEN x < 41.5 THEN 'knee' WHEN x < 45.5 THEN 'midi' WHEN x < 51 THEN 'mid_calf' WHEN x < 57.5 THEN 'maxi'
  ELSE 'floor' END AS length_class FROM (SELECT p_partkey, 20 + p_size AS x FROM part)"""))
def _(spark, d):
    return T.read(spark, d, "part").select(
        "p_partkey", H.class_from_inches((20 + F.col("p_size")).cast("double")).alias("length_class"))


DECAY = f"""exp(-ln(2.0::DOUBLE) * greatest(({NOW} - last_seen_ms) / 86400000.0::DOUBLE, 0) /
  CASE WHEN source_id LIKE 'ebay:%' THEN 7.0::DOUBLE ELSE 21.0::DOUBLE END)"""


@query("freshness_decay", sql(f"SELECT listing_id, round({DECAY}, 6) AS decay FROM listings", "listings"))
def _(spark, d):
    decay = S.freshness_decay(S.age_days(NOW, F.col("last_seen_ms")), S.half_life_days(F.col("source_id")))
    return T.listings(spark, d).select("listing_id", F.round(decay, 6).alias("decay"))


# Palette entries and listing colors by name and family; within this data only equal names are within reach of each other.
RGB = """SELECT * FROM (VALUES ('red', 220, 20, 60), ('navy', 0, 0, 128), ('emerald', 80, 200, 120), ('ivory', 255, 255, 240),
  ('rust', 183, 65, 14), ('blue', 0, 0, 205)) AS t(name, r, g, b)"""
LISTING_COLORS = """SELECT listing_id, unnest(list_filter([(['navy', 'emerald', 'ivory', NULL, 'rust'])[(listing_key // 42) % 5 + 1],
  CASE split_part(p_name, ' ', 1) WHEN 'red' THEN 'red' WHEN 'blue' THEN 'blue' END], lambda c: c IS NOT NULL)) AS color FROM listings"""
COLOR_HITS = """SELECT p.color AS swatch, c.name AS color, sqrt((s.r - c.r) ** 2 + (s.g - c.g) ** 2 + (s.b - c.b) ** 2) <= 80 AS near
  FROM (SELECT DISTINCT name AS color FROM rgb WHERE name IN ('red', 'navy', 'emerald', 'ivory')) p JOIN rgb s ON s.name = p.color, rgb c"""
PALETTE = """SELECT user_id, listing_id, count(*) AS n, count(*) FILTER (hit) AS hits FROM (SELECT q.user_id, q.listing_id, lc.color,
  bool_or(coalesce(near, false)) AS hit FROM pairs q JOIN lc USING (listing_id) LEFT JOIN (SELECT user_id, unnest(palette) AS swatch
  FROM users) us ON us.user_id = q.user_id LEFT JOIN ch ON ch.swatch = us.swatch AND ch.color = lc.color GROUP BY ALL) GROUP BY ALL"""
SIM = """SELECT q.user_id, q.listing_id, CASE WHEN un IS NULL OR ln IS NULL OR un = 0 THEN 0.5::DOUBLE
  ELSE (coalesce(dot, 0) / (sqrt(un) * sqrt(ln)) + 1) / 2 END AS sim FROM pairs q
  LEFT JOIN (SELECT user_id, sum(w * w) AS un FROM style_tags GROUP BY user_id) USING (user_id)
  LEFT JOIN (SELECT listing_id, sum(w * w) AS ln FROM tags GROUP BY listing_id) USING (listing_id)
  LEFT JOIN (SELECT q.user_id, q.listing_id, sum(s.w * t.w) AS dot FROM pairs q JOIN tags t USING (listing_id)
    JOIN style_tags s ON s.user_id = q.user_id AND s.tag = t.tag GROUP BY ALL) USING (user_id, listing_id)"""
SCORES = f"""SELECT p.*, sim, coalesce(hits, 0) > 0 AS palette_match, round(greatest(0, least(1, sim * CASE WHEN palette_boost_enabled IS NOT FALSE
  AND len(palette) > 0 AND n > 0 THEN 1 + 0.25::DOUBLE * (hits::DOUBLE / n) ELSE 1.0::DOUBLE END * {DECAY})), 9) AS score
  FROM (SELECT q.*, l.last_seen_ms, l.source_id, l.brand, u.palette, u.palette_boost_enabled FROM pairs q JOIN listings l USING (listing_id)
    JOIN users u USING (user_id)) p LEFT JOIN pal USING (user_id, listing_id) LEFT JOIN sims USING (user_id, listing_id)"""
PARTS = dict(rgb=RGB, lc=LISTING_COLORS, ch=COLOR_HITS)


@query("attribute_similarity", sql("SELECT user_id, listing_id, round(sim, 6) AS sim FROM sims", "users", "listings", "tags",
                                   "style_tags", pairs="SELECT user_id, listing_id FROM users JOIN {OWNED} ON owner = user_id",
                                   sims=SIM))
def _(spark, d):
    return own_pairs(spark, d).select("user_id", "listing_id", F.round(
        S.attribute_similarity(F.col("style_tags"), F.col("attribute_vector")), 6).alias("sim"))


@query("palette_boosts", sql("""SELECT user_id, listing_id, round(CASE WHEN len(palette) > 0 AND n > 0 THEN 1 + 0.25::DOUBLE * hits / n
  ELSE 1 END, 6) AS boost, coalesce(hits, 0) > 0 AS hit FROM pairs JOIN users USING (user_id) LEFT JOIN pal USING (user_id, listing_id)""",
                             "users", "listings", **PARTS,
                             pairs="SELECT user_id, listing_id FROM users JOIN {OWNED} ON owner = user_id", pal=PALETTE))
def _(spark, d):
    return own_pairs(spark, d).select(
        "user_id", "listing_id", F.round(S.palette_boost(F.col("palette"), F.col("colors")), 6).alias("boost"),
        S.palette_match(F.col("palette"), F.col("colors")).alias("hit"))


POOLS = """SELECT profile, listing_id FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY rs, last_seen_ms DESC, listing_id) AS pos
  FROM (SELECT *, row_number() OVER (PARTITION BY profile, source_id ORDER BY rb, last_seen_ms DESC, listing_id) AS rs
  FROM (SELECT *, row_number() OVER (PARTITION BY profile, source_id, lower(trim(coalesce(brand, ''))) ORDER BY last_seen_ms DESC, listing_id)
    AS rb FROM matched))) WHERE pos <= {cap}"""
LIVE = f"""SELECT l.* FROM listings l JOIN sources USING (source_id) JOIN attrs USING (listing_id) WHERE removed_ms IS NULL
  AND coalesce(audience, 'adult') <> 'child' AND last_seen_ms >= {NOW} - {HOUR} * CASE kind WHEN 'ebay' THEN 24 WHEN 'shopify' THEN 48 ELSE 96 END"""
PROFILES = """SELECT user_id, array_to_string(list_sort(sizes), ',') || '|' || coalesce(CAST(budget_min_cents AS VARCHAR), '-') || '|'
  || coalesce(CAST(budget_max_cents AS VARCHAR), '-') AS profile, sizes, budget_min_cents AS low, budget_max_cents AS high FROM users"""
MATCHED = """SELECT DISTINCT p.profile, l.listing_id, l.source_id, l.brand, l.last_seen_ms FROM (SELECT DISTINCT profile, sizes, low, high
  FROM profiles) p JOIN live l ON (len(p.sizes) = 0 OR len(l.size_normalized) = 0 OR list_has_any(l.size_normalized, p.sizes))
  AND (p.low IS NULL OR l.usd_cents >= p.low) AND (p.high IS NULL OR l.usd_cents <= p.high)"""


def pool_query(name, cap):
    @query(name, sql("SELECT profile AS profile_id, listing_id FROM pool", "users", "listings", "attrs", "sources",
                     live=LIVE, profiles=PROFILES, matched=MATCHED, pool=POOLS.format(cap=cap)))
    def _(spark, d):
        live = feed.live_catalog(T.candidates(spark, d), T.sources(spark, d), NOW)
        return feed.pools(T.users(spark, d), live, cap).select("profile_id", "listing_id")


pool_query("profile_pools", 500)
pool_query("profile_pools_30", 30)

FIT_PROFILES = """SELECT profile || CASE WHEN body_bust IS NULL THEN '' ELSE '|' || body_bust || ',' || body_waist || ',' || body_hip END AS profile, sizes, low, high,
  body_bust, body_waist, body_hip FROM profiles JOIN (SELECT user_id, body_bust, body_waist, body_hip FROM users) USING (user_id)"""
FIT_MATCHED = """SELECT p.profile, l.listing_id, l.source_id, l.brand, l.last_seen_ms FROM (SELECT DISTINCT * FROM fit_profiles) p JOIN
  (SELECT live.*, bust, waist, CASE coalesce(silhouette, 'other') WHEN 'bodycon' THEN 1.0 WHEN 'sheath' THEN 1.5 WHEN 'slip' THEN 1.5
    WHEN 'a_line' THEN 2.5 WHEN 'wrap' THEN 2.5 ELSE 2.0 END AS ease FROM live JOIN attrs USING (listing_id)) l
  ON (p.low IS NULL OR l.usd_cents >= p.low) AND (p.high IS NULL OR l.usd_cents <= p.high) AND (len(p.sizes) = 0 OR CASE
    WHEN body_bust IS NOT NULL AND bust IS NOT NULL THEN bust BETWEEN body_bust - 1 AND body_bust + ease + 2 AND waist BETWEEN body_waist - 1 AND body_waist + ease + 2
    WHEN len(l.size_normalized) = 0 THEN true
    WHEN l.is_vintage THEN len(list_filter(l.size_normalized, lambda s: len(list_filter(p.sizes, lambda u: u >= s - 6 AND u <= s - 2)) > 0)) > 0
    ELSE list_has_any(l.size_normalized, p.sizes) END)"""


def fit_pool_query(name, cap):
    @query(name, sql("SELECT profile AS profile_id, listing_id FROM pool", "users", "listings", "attrs", "sources", live=LIVE,
                     profiles=PROFILES, fit_profiles=FIT_PROFILES, matched=FIT_MATCHED, pool=POOLS.format(cap=cap)))
    def _(spark, d):
        live = feed.live_catalog(T.candidates(spark, d), T.sources(spark, d), NOW)
        return feed.pools(T.users(spark, d), live, cap, "fit").select("profile_id", "listing_id")


fit_pool_query("profile_pools_fit", 500)
fit_pool_query("profile_pools_fit_30", 30)

FEED_PAIRS = f"""SELECT user_id, listing_id, position, basis FROM (SELECT * FROM hems) WHERE len(length_prefs) = 0
  OR list_contains(length_prefs, position)"""
FEED_HEMS = hem_sql("SELECT u.*, a.* FROM users u JOIN profiles USING (user_id) JOIN pool USING (profile) JOIN attrs a USING (listing_id)")
RANKED = """SELECT user_id, listing_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, CASE WHEN basis = 'measured_length'
  THEN 0 ELSE 1 END, last_seen_ms DESC, listing_id) - 1 AS rank, round(score, 6) AS score, position, palette_match FROM scored"""
FEED_NEEDS = ("users", "listings", "attrs", "sources", "tags", "style_tags")


def feed_sql(body, **more):
    return sql(body, *FEED_NEEDS, **PARTS, live=LIVE, profiles=PROFILES, matched=MATCHED, pool=POOLS.format(cap=500),
               hems=FEED_HEMS, pairs=FEED_PAIRS, pal=PALETTE, sims=SIM, scored=SCORES, ranked=RANKED, **more)


def ranked_pairs(spark, d):
    users, sources = T.users(spark, d), T.sources(spark, d)
    live = feed.live_catalog(T.candidates(spark, d), sources, NOW)
    return feed.ranked(feed.scored_pairs(users, live, feed.pools(users, live), NOW))


@query("feed_ranked", feed_sql("SELECT * FROM ranked"))
def _(spark, d):
    return ranked_pairs(spark, d).select("user_id", "listing_id", "rank", F.round("score", 6).alias("score"),
                                         F.col("hem.position").alias("position"), "palette_match")


@query("batch_feed")
def _(spark, d):
    return feed.batch_feed(T.users(spark, d), T.candidates(spark, d), T.sources(spark, d), NOW).select(
        "user_id", "position", "listing_id", "rank", F.round("score", 6).alias("score"))


@query("feed_membership", feed_sql("SELECT user_id, count(*) AS n, min(rank) AS first, max(rank) AS last, CAST(sum(CAST(round(score * 1000000) AS BIGINT)) AS BIGINT) AS total "
                                   "FROM ranked GROUP BY user_id"))
def _(spark, d):
    f = feed.batch_feed(T.users(spark, d), T.candidates(spark, d), T.sources(spark, d), NOW)
    return f.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("position").cast("long").alias("first"),
                                    F.max("position").cast("long").alias("last"),
                                    F.sum(F.round(F.round("score", 6) * 1000000).cast("long")).alias("total"))


@query("feed_spread_report")
def _(spark, d):
    f = feed.batch_feed(T.users(spark, d), T.candidates(spark, d), T.sources(spark, d), NOW)
    return spread_report(f, "user_id")


@query("feed_page_reasons")
def _(spark, d):
    users, catalog = T.users(spark, d), T.candidates(spark, d)
    page = feed.feed_page(feed.batch_feed(users, catalog, T.sources(spark, d), NOW), 24, 24)
    return feed.explain_line(page, users, catalog).select("user_id", "position", "listing_id", "why")


@query("templated_reasons", sql("""SELECT user_id, listing_id, coalesce(nullif(array_to_string(list_filter(CASE WHEN two THEN [a, b] ELSE [a, b, c] END,
  lambda x: x IS NOT NULL), ' and '), ''), 'Fresh ' || coalesce(brand, 'find') || ' in your size and budget') || '.' AS why
FROM (SELECT *, a IS NOT NULL AND b IS NOT NULL AS two FROM (SELECT h.user_id, h.listing_id, l.brand, 'Hits ' || replace(position, '_', ' ') || ' on you' AS a,
  hit || ' is in your palette' AS b, replace(silhouette, '_', ' ') || ' shape suits your saved styles' AS c FROM hems h JOIN listings l
  ON l.listing_id = h.listing_id LEFT JOIN (SELECT user_id, listing_id, arg_min(color, ord) AS hit FROM (SELECT u.user_id, lc.listing_id, color,
    CASE color WHEN 'ivory' THEN 1 WHEN 'navy' THEN 2 WHEN 'blue' THEN 3 WHEN 'emerald' THEN 4 WHEN 'rust' THEN 5 ELSE 6 END AS ord
    FROM users u JOIN {OWNED} x ON x.owner = u.user_id JOIN lc ON lc.listing_id = x.listing_id WHERE list_contains(u.palette, lc.color))
    GROUP BY ALL) k ON k.user_id = h.user_id AND k.listing_id = h.listing_id))""", "users", "listings", "attrs", hems=hem_sql(PAIRS), lc=LISTING_COLORS))
def _(spark, d):
    h = H.hem(F.col("length_inches"), F.col("length_class"), F.col("height_inches"), F.col("heel_inches"))
    rows = own_pairs(spark, d).withColumns({"p": h["position"], "season": F.lit(None).cast("string")})
    return rows.select("user_id", "listing_id",
                       templated_reason("p", "palette", "colors", "season", "silhouette", "brand").alias("why"))


@query("rerank_merge", feed_sql("""SELECT user_id, listing_id, new_rank AS rank, CASE WHEN rank < 24 THEN
  round(round(0.6::DOUBLE * CASE WHEN head <= 1 THEN 1.0 ELSE 1 - new_rank::DOUBLE / (head - 1) END + 0.4::DOUBLE * score9, 9), 6) ELSE round(score9, 6) END AS score
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN rank < 24 THEN 0 ELSE 1 END, CASE WHEN rank < 24
    AND place IS NOT NULL THEN place WHEN rank < 24 THEN 1073741824 END, rank) - 1 AS new_rank, count(*) FILTER (rank < 24) OVER (PARTITION BY user_id) AS head
  FROM (SELECT r.user_id, r.listing_id, r.rank, s.score AS score9, CASE WHEN l.listing_key % 3 = 0 THEN l.listing_key % 101 * 100000 + l.listing_key END AS place
    FROM ranked r JOIN scored s USING (user_id, listing_id) JOIN listings l USING (listing_id)))"""))
def _(spark, d):
    rows = ranked_pairs(spark, d)
    key = F.substring("listing_id", 2, 20).cast("long")
    external = rows.filter(key % 3 == 0).select("user_id", "listing_id", (key % 101 * 100000 + key).alias("place"))
    return feed.apply_rerank(rows, external).select("user_id", "listing_id", "rank", F.round("score", 6).alias("score"))


@query("head_fingerprints", feed_sql("SELECT user_id, sha256('[' || string_agg('\"' || listing_id || '\"', ',' ORDER BY listing_id) || ']') "
                                     "AS fingerprint FROM ranked WHERE rank < 24 GROUP BY user_id"))
def _(spark, d):
    head = ranked_pairs(spark, d).filter(F.col("rank") < 24)
    return head.groupBy("user_id").agg(set_fingerprint(F.collect_set("listing_id")).alias("fingerprint"))


# --- vectors and neighbours ------------------------------------------------------------------------------------
PAIR_COS = "list_cosine_similarity(a.vector::DOUBLE[], b.vector::DOUBLE[])"


@query("similar_by_vector", sql(f"""SELECT listing_id, similar_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER
  (PARTITION BY listing_id ORDER BY score DESC, similar_id) AS rank FROM (SELECT a.listing_id, b.listing_id AS similar_id,
  round({PAIR_COS}, 9) AS score FROM cur a JOIN cur b ON a.listing_id <> b.listing_id)) WHERE rank <= 12""", "vectors", "listings",
                                cur="SELECT v.* FROM vectors v JOIN listings l ON l.listing_id = v.listing_id AND "
                                    "l.content_hash = v.content_hash WHERE removed_ms IS NULL"))
def _(spark, d):
    from garderobe.operators.joins import with_vectors
    l = T.listings(spark, d)
    return similar.similar_by_vector(with_vectors(l, T.embeddings(spark, d, l), T.MODEL)).select(
        "listing_id", "similar_id", "rank", F.round("score", 6).alias("score"))


@query("probe_neighbours", sql(f"""SELECT probe_id, listing_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY probe_id
  ORDER BY score DESC, listing_id) AS rank FROM (SELECT a.vec_id AS probe_id, b.listing_id, (round({PAIR_COS}, 9) + 1) / 2 AS score
  FROM (SELECT vec_id, embedding AS vector FROM embeddings) a, vectors b)) WHERE rank <= 5""", "vectors"))
def _(spark, d):
    probes = T.read(spark, d, "embeddings").select(F.col("vec_id").alias("probe_id"), F.col("embedding").alias("vector"))
    return similar.probe_neighbours(probes, T.embeddings(spark, d), 5).select(
        "probe_id", "listing_id", "rank", F.round("score", 6).alias("score"))


TAG_SCORES = """SELECT a.listing_id, b.listing_id AS similar_id, round(sum(a.w * b.w) / (any_value(na.n) * any_value(nb.n)), 9) AS score
  FROM tags a JOIN tags b ON a.tag = b.tag AND a.listing_id <> b.listing_id JOIN norms na ON na.listing_id = a.listing_id
  JOIN norms nb ON nb.listing_id = b.listing_id JOIN ok oa ON oa.listing_id = a.listing_id JOIN ok ob ON ob.listing_id = b.listing_id GROUP BY ALL"""


@query("similar_by_tags", sql("""SELECT listing_id, similar_id, rank, round(score, 6) AS score, basis FROM (SELECT s.listing_id, similar_id, score, 'tags' AS basis,
  row_number() OVER (PARTITION BY s.listing_id ORDER BY score DESC, last_seen_ms DESC, similar_id) AS rank FROM ts s JOIN listings l
  ON l.listing_id = s.similar_id WHERE score > 0
  UNION ALL SELECT a.listing_id, b.listing_id, 0.0, 'fallback', row_number() OVER (PARTITION BY a.listing_id ORDER BY b.last_seen_ms DESC, b.listing_id)
  FROM (SELECT * FROM shapes WHERE listing_id NOT IN (SELECT listing_id FROM ts WHERE score > 0)) a JOIN shapes b ON a.listing_id <> b.listing_id
  AND (a.silhouette = b.silhouette OR a.length_class = b.length_class)) WHERE rank <= 12""", "tags", "listings", "attrs",
                              norms="SELECT listing_id, sqrt(sum(w * w)) AS n FROM tags GROUP BY listing_id",
                              ok="SELECT listing_id FROM listings WHERE removed_ms IS NULL", ts=TAG_SCORES,
                              shapes="SELECT listing_id, silhouette, length_class, last_seen_ms FROM listings JOIN attrs USING (listing_id) WHERE removed_ms IS NULL"))
def _(spark, d):
    near = similar.similar_by_tags(T.candidates(spark, d).filter(P.active()))
    return near.select(F.col("probe_id").alias("listing_id"), F.col("listing_id").alias("similar_id"), "rank", F.round("score", 6).alias("score"), "basis")


@query("nearest_or_newest", sql("""SELECT user_id AS probe_id, listing_id, rank, round(score, 6) AS score, fallback FROM
 (SELECT user_id, listing_id, score, 'none' AS fallback, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, last_seen_ms DESC, listing_id)
    AS rank FROM (SELECT user_id, listing_id, any_value(last_seen_ms) AS last_seen_ms, round(sum(t.w * s.w) / (any_value(un) * any_value(n)), 9) AS score
    FROM style_tags s JOIN tags t USING (tag) JOIN norms USING (listing_id) JOIN listings l USING (listing_id) JOIN unorms USING (user_id)
    WHERE removed_ms IS NULL GROUP BY user_id, listing_id) WHERE score > 0
  UNION ALL SELECT user_id, listing_id, 0, 'nearest', rank FROM (SELECT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN
    (SELECT user_id FROM style_tags JOIN tags USING (tag) JOIN listings USING (listing_id) WHERE removed_ms IS NULL GROUP BY user_id, listing_id
     HAVING round(sum(style_tags.w * tags.w), 9) > 0)), (SELECT listing_id, row_number() OVER (ORDER BY last_seen_ms DESC, listing_id) AS rank
    FROM listings JOIN attrs USING (listing_id) WHERE removed_ms IS NULL AND confidence >= 0.35)) WHERE rank <= 8""", "tags", "style_tags", "listings", "attrs",
                                norms="SELECT listing_id, sqrt(sum(w * w)) AS n FROM tags GROUP BY listing_id",
                                unorms="SELECT user_id, sqrt(sum(w * w)) AS un FROM style_tags GROUP BY user_id"))
def _(spark, d):
    probes = T.users(spark, d).select(F.col("user_id").alias("probe_id"), F.col("style_tags").alias("attribute_vector"))
    pool = T.candidates(spark, d).filter(P.active())
    return similar.nearest_or_newest(probes, pool, 8, 0.35).select(
        "probe_id", "listing_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), "fallback")


@query("vector_codec_round_trip", sql("SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 4) AS total, len(embedding) AS dim FROM embeddings"))
def _(spark, d):
    back = X.decode_floats(X.encode_floats(F.col("embedding")))
    total = F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return T.read(spark, d, "embeddings").select("vec_id", back.alias("v")).select(
        "vec_id", F.round(total, 4).alias("total"), F.size("v").alias("dim"))


@query("embedding_similarity", sql("""SELECT a.vec_id, round((list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 1) / 2, 6) AS sim
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""))
def _(spark, d):
    a = T.read(spark, d, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(X.embedding_similarity(F.col("embedding"), F.col("other")), 6).alias("sim"))


@query("dense_sparse_round_trip", sql("SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 5) AS norm2 FROM embeddings"))
def _(spark, d):
    v = X.sparse_to_dense(X.dense_to_sparse(F.col("embedding")), 64)
    norm2 = F.aggregate(F.col("v"), F.lit(0.0), lambda a, x: a + x * x)
    return T.read(spark, d, "embeddings").select("vec_id", v.alias("v")).select("vec_id", F.round(norm2, 5).alias("norm2"))


# --- taste -----------------------------------------------------------------------------------------------------
def fold_sql(rates, clamp, prune):
    case = " ".join(f"WHEN '{v}' THEN {r}::DOUBLE" for v, r in rates.items())
    return sql(f"""SELECT user_id, tag, round(v, 6) AS value FROM (SELECT user_id, tag, arg_max(v, rn) AS v FROM fold GROUP BY user_id, tag)
  WHERE round(abs(v), 9) >= {prune}""", "swipes", "tags", steps=f"""SELECT user_id, tag, w * CASE verdict {case} END AS d, row_number() OVER
  (PARTITION BY user_id, tag ORDER BY created_ms, swipe_id) AS rn FROM swipes JOIN tags USING (listing_id)""",
               fold=f"""SELECT user_id, tag, rn, greatest(-{clamp}::DOUBLE, least({clamp}::DOUBLE, d)) AS v FROM steps WHERE rn = 1
  UNION ALL SELECT s.user_id, s.tag, s.rn, greatest(-{clamp}::DOUBLE, least({clamp}::DOUBLE, f.v + s.d)) FROM fold f JOIN steps s
  ON s.user_id = f.user_id AND s.tag = f.tag AND s.rn = f.rn + 1""").replace("WITH ", "WITH RECURSIVE ", 1)


def taste_query(name, preset, rates, clamp, prune):
    @query(name, fold_sql(rates, clamp, prune))
    def _(spark, d):
        tags = taste.style_tags(T.swipes(spark, d), T.candidates(spark, d), preset)
        return tags.select("user_id", "tag", F.round("value", 6).alias("value"))


taste_query("style_tags_live", "live", {"like": 0.15, "save": 0.25, "dislike": -0.15, "skip": -0.03}, 1, 0.005)
taste_query("style_tags_package", "package", {"like": 0.25, "save": 0.3125, "dislike": -0.25, "skip": -0.05}, 2, 0.01)

LATEST = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_ms DESC, swipe_id DESC) AS rn FROM swipes
  WHERE verdict IN ('like', 'save')) WHERE rn <= {n}"""


@query("latest_positives", sql("SELECT user_id, swipe_id FROM latest", "swipes", latest=LATEST.format(n=25)))
def _(spark, d):
    return taste.positives(T.swipes(spark, d), 25).select("user_id", "swipe_id")


@query("style_embeddings", sql("""SELECT user_id, dim, round(x / n, 5) AS x FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY user_id)) AS n FROM
  (SELECT user_id, dim, sum(w * x) / sum(w) AS x FROM (SELECT user_id, CASE WHEN verdict = 'save' THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END AS w,
  unnest(range(64)) AS dim, unnest(vector::DOUBLE[]) AS x FROM latest JOIN vectors USING (listing_id)) GROUP BY user_id, dim))""",
                               "swipes", "vectors", latest=LATEST.format(n=200)))
def _(spark, d):
    e = taste.style_embeddings(T.swipes(spark, d), T.embeddings(spark, d))
    return e.select("user_id", F.posexplode("vector").alias("dim", "x")).select(
        "user_id", F.col("dim").cast("long").alias("dim"), F.round("x", 5).alias("x"))


@query("dense_style_update", sql("""SELECT user_id, dim, round(x / n, 5) AS x FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY user_id)) AS n FROM
  (SELECT user_id, dim, sum(w * x) AS x FROM (SELECT user_id, CASE verdict WHEN 'like' THEN 0.25::DOUBLE WHEN 'save' THEN 0.3125::DOUBLE
  WHEN 'dislike' THEN -0.25::DOUBLE ELSE -0.05::DOUBLE END AS w, unnest(range(64)) AS dim, unnest(vector::DOUBLE[]) AS x FROM swipes JOIN vectors
  USING (listing_id) UNION ALL SELECT vec_id, 1.0, unnest(range(64)), unnest(embedding::DOUBLE[]) FROM embeddings WHERE vec_id IN
  (SELECT user_id FROM swipes)) GROUP BY user_id, dim))""", "swipes", "vectors"))
def _(spark, d):
    swipes = T.swipes(spark, d)
    current = T.read(spark, d, "embeddings").select(F.col("vec_id").alias("user_id"), F.col("embedding").alias("vector"))
    current = current.join(swipes.select("user_id"), "user_id", "left_semi")
    e = taste.dense_style_update(current, swipes, T.embeddings(spark, d))
    return e.select("user_id", F.posexplode("vector").alias("dim", "x")).select(
        "user_id", F.col("dim").cast("long").alias("dim"), F.round("x", 5).alias("x"))


# --- rack ------------------------------------------------------------------------------------------------------
@query("saved_listings", sql("SELECT user_id, listing_id, max(created_ms) AS saved_ms FROM swipes WHERE verdict = 'save' GROUP BY ALL", "swipes"))
def _(spark, d):
    return rack.saved(T.swipes(spark, d))


@query("rack", sql(f"""SELECT user_id, listing_id, saved_ms, position, palette_match, round(score, 6) AS score, removed_ms IS NOT NULL OR
  last_seen_ms < {NOW} - {HOUR} * CASE kind WHEN 'ebay' THEN 24 WHEN 'shopify' THEN 48 ELSE 96 END AS possibly_sold
FROM scored s JOIN (SELECT user_id, listing_id, position FROM hems) USING (user_id, listing_id) JOIN sv USING (user_id, listing_id)
  JOIN (SELECT listing_id, removed_ms FROM listings) USING (listing_id) JOIN (SELECT source_id, kind FROM sources) USING (source_id)""",
                   *FEED_NEEDS, "swipes", **PARTS,
                   sv="SELECT user_id, listing_id, max(created_ms) AS saved_ms FROM swipes WHERE verdict = 'save' GROUP BY ALL",
                   pairs="SELECT user_id, listing_id FROM sv JOIN users USING (user_id) JOIN listings USING (listing_id)",
                   hems=hem_sql("SELECT u.*, a.* FROM sv JOIN users u USING (user_id) JOIN attrs a USING (listing_id)"),
                   pal=PALETTE, sims=SIM, scored=SCORES))
def _(spark, d):
    rows = rack.rack(T.users(spark, d), T.swipes(spark, d), T.candidates(spark, d), T.sources(spark, d), NOW)
    return rows.select("user_id", "listing_id", "saved_ms", F.col("hem.position").alias("position"), "palette_match",
                       F.round("score", 6).alias("score"), "possibly_sold")


@query("save_state", sql("""SELECT user_id, listing_id, min(created_ms) AS saved_ms FROM acts a WHERE act = 'save' AND NOT EXISTS (SELECT 1 FROM acts b
  WHERE b.user_id = a.user_id AND b.listing_id = a.listing_id AND b.act = 'unsave' AND (b.created_ms, b.swipe_id) > (a.created_ms, a.swipe_id))
  GROUP BY ALL""", "swipes", acts="SELECT user_id, listing_id, swipe_id, created_ms, CASE WHEN verdict IN ('save', 'like') "
                                  "THEN 'save' ELSE 'unsave' END AS act FROM swipes"))
def _(spark, d):
    acts = T.swipes(spark, d).select(
        "user_id", "listing_id", "created_ms",
        F.col("swipe_id").alias("action_id"), F.when(F.col("verdict").isin("save", "like"), "save").otherwise("unsave").alias("action"))
    return rack.save_state(acts)


@query("saved_flags", sql("""SELECT user_id, listing_id, EXISTS (SELECT 1 FROM swipes s WHERE s.verdict = 'save' AND s.user_id = w.user_id
  AND s.listing_id = w.listing_id) AS saved FROM (SELECT DISTINCT user_id, listing_id FROM swipes) w""", "swipes"))
def _(spark, d):
    s = T.swipes(spark, d)
    return rack.is_saved(s.select("user_id", "listing_id").distinct(), rack.saved(s)).select("user_id", "listing_id", "saved")


@query("recent_swipes", sql("""SELECT user_id, swipe_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_ms DESC, swipe_id DESC)
  AS rn FROM swipes) WHERE rn <= 10""", "swipes"))
def _(spark, d):
    return top_n(T.swipes(spark, d), ["user_id"], [F.desc("created_ms"), F.desc("swipe_id")], 10).select("user_id", "swipe_id")
