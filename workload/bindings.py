"""SQL twins of the relations in garderobe.sources.tables, as named CTEs."""

from __future__ import annotations

NOW = 1005004800000
EVENTS_NOW = 1706659200000
HOUR = 3600000
DAY = 86400000


def pick(values, index):
    items = ", ".join("NULL" if v is None else "'" + v + "'" for v in values)
    return f"([{items}])[CAST({index} AS BIGINT) + 1]"


def source_of(n):
    return f"{pick(['shopify', 'ebay', 'jsonld', 'fixture'], f'{n} % 4')} || ':n' || CAST({n} AS VARCHAR)"


LENGTH_TERMS = ["mini", "midi", "maxi", "knee-length", "floor-length", "micro", None]
LENGTH_CLASSES = ["mini", "midi", "maxi", "knee", "floor", "micro", None]
SILHOUETTE_TERMS = ["wrap", "slip", "a-line", "bodycon", "shift", None]
SILHOUETTES = ["wrap", "slip", "a_line", "bodycon", "sheath", None]
COLOR_TERMS = ["navy", "emerald", "ivory", None, "rust"]
COLOR_FAMILIES = ["blue", "green", "white", None, "orange"]
FABRIC_TERMS = ["silk", "cotton poplin", "linen", "velvet", None, "jersey knit"]
FABRIC_HEADS = ["silk", "cotton", "linen", "velvet", None, "jersey"]
NECK_TERMS = ["v-neck", "halter", None, "square neck"]
NECKS = ["v_neck", "halter", None, "square"]
OCCASION_TERMS = ["cocktail", "wedding guest", None, "brunch"]
OCCASIONS = ["cocktail", "wedding_guest", None, "brunch"]
PATTERN_TERMS = ["floral", None, "polka dot", None, "gingham"]
PATTERNS = ["floral", None, "polka_dot", None, "gingham"]

K = "p_partkey"
D42, D5, D7, D11 = (f"({K} // {n})" for n in (42, 5, 7, 11))

SIZE_OF_LABEL = """CASE
  WHEN regexp_matches(trim(x), '^(us\\s*|size\\s*)?0*\\d{1,2}$', 'i') THEN
    (CASE WHEN CAST(regexp_extract(trim(x), '(\\d{1,2})$', 1) AS INTEGER) > 26 THEN []
      WHEN CAST(regexp_extract(trim(x), '(\\d{1,2})$', 1) AS INTEGER) % 2 = 0
        THEN [CAST(regexp_extract(trim(x), '(\\d{1,2})$', 1) AS INTEGER)]
      ELSE [CAST(regexp_extract(trim(x), '(\\d{1,2})$', 1) AS INTEGER) - 1,
            CAST(regexp_extract(trim(x), '(\\d{1,2})$', 1) AS INTEGER) + 1] END)
  WHEN upper(regexp_replace(trim(x), '[\\s.+]+$', '')) = 'S' THEN [4, 6]
  WHEN upper(regexp_replace(trim(x), '[\\s.+]+$', '')) = 'M' THEN [8, 10]
  WHEN upper(regexp_replace(trim(x), '[\\s.+]+$', '')) = 'L' THEN [12, 14]
  WHEN upper(regexp_replace(trim(x), '[\\s.+]+$', '')) = 'XL' THEN [16]
  WHEN upper(regexp_replace(trim(x), '[\\s.+]+$', '')) = '1X' THEN [16, 18]
  ELSE [] END"""

CTES: dict[str, tuple[list[str], str]] = {}

CTES["sources"] = ([], f"""
SELECT {source_of('n_nationkey')} AS source_id, {pick(['shopify', 'ebay', 'jsonld', 'fixture'], 'n_nationkey % 4')} AS kind,
  n_name AS display_name,
  {pick(['0 */6 * * *', '*/30 * * * *', '0 6 * * *', '0 0 1 * *'], 'n_nationkey % 4')} AS cadence_cron,
  n_nationkey % 5 <> 0 AS enabled FROM nation""")

CTES["seen"] = ([], """
SELECT l_partkey, min(l_suppkey) AS suppkey, max(l_shipdate) AS ship FROM lineitem GROUP BY l_partkey""")

CTES["listings0"] = (["seen"], f"""
SELECT 'p' || {K} AS listing_id, {K} AS listing_key, {source_of('s_nationkey')} AS source_id, s_nationkey AS nation,
  CAST({K} AS VARCHAR) AS source_listing_id,
  'https://store' || s_nationkey || '.example.com/products/' || {K} || '?utm_source=feed&variant=2' AS source_url,
  concat_ws(' ', p_name, {pick(COLOR_TERMS, f'{D42} % 5')}, {pick(PATTERN_TERMS, f'{K} % 5')},
    {pick(FABRIC_TERMS, f'{D5} % 6')}, {pick(SILHOUETTE_TERMS, f'{D7} % 6')}, {pick(LENGTH_TERMS, f'{K} % 7')},
    'dress', CASE WHEN {K} % 29 = 0 THEN 'for girls' END) AS title,
  CASE WHEN {K} % 9 <> 0 THEN concat_ws(' ', 'A piece', 'for ' || {pick(OCCASION_TERMS, f'{K} % 4')},
    'with ' || {pick(NECK_TERMS, f'{D11} % 4')},
    CASE WHEN {K} % 3 = 0 THEN 'Bust: ' || (30 + {K} % 20) || ' in, waist ' || (24 + {K} % 20) || ' in, length: '
      || (32 + {K} % 30) || ' in' END) END AS description,
  CASE WHEN {K} % 31 <> 0 THEN p_brand END AS brand,
  CAST(round(p_retailprice * 100) AS BIGINT) AS price_cents,
  {pick(['USD'] * 6 + ['GBP', 'EUR', 'CAD', 'JPY'], f'{K} % 10')} AS currency,
  {pick(['new', 'like_new', 'good', 'fair', 'unknown'], 'p_size % 5')} AS condition,
  {K} % 7 = 0 AS is_vintage, p_size, p_name,
  CASE p_size % 6 WHEN 0 THEN ['S', 'M'] WHEN 1 THEN [CAST(p_size AS VARCHAR)] WHEN 2 THEN CAST([] AS VARCHAR[])
    WHEN 3 THEN ['XL', '1X'] WHEN 4 THEN ['US ' || (p_size % 28)] ELSE ['0' || (p_size % 10), 'L+', 'OS'] END AS size_labels,
  list_transform(range(CAST({K} % 4 AS BIGINT)), lambda i: CASE WHEN {K} % 23 = 0 THEN 'https://placehold.co/' ELSE
    'https://img.example.com/' END || {K} || '/' || i || '.jpg') AS image_urls,
  {NOW} - date_diff('day', CAST(ship AS DATE), DATE '2001-11-05') * {HOUR} AS last_seen_ms,
  CASE WHEN {K} % 17 = 0 THEN {NOW} - ({K} % 100) * {HOUR} END AS removed_ms
FROM part JOIN seen ON l_partkey = {K} JOIN supplier ON s_suppkey = suppkey""")

CTES["listings"] = (["listings0"], f"""
SELECT *, CASE WHEN listing_key % 2 = 0 THEN source_url || '&campid=1' END AS affiliate_url,
  last_seen_ms - (listing_key % 30) * {DAY} AS first_seen_ms,
  CASE WHEN listing_key % 3 = 0 THEN last_seen_ms END AS verified_ms,
  list_sort(list_distinct(flatten(list_transform(size_labels, lambda x: {SIZE_OF_LABEL})))) AS size_normalized,
  CAST(floor(price_cents * CASE currency WHEN 'GBP' THEN 1.27::DOUBLE WHEN 'EUR' THEN 1.08::DOUBLE
    WHEN 'CAD' THEN 0.73::DOUBLE WHEN 'AUD' THEN 0.66::DOUBLE ELSE 1.0::DOUBLE END + 0.5) AS BIGINT) AS usd_cents,
  sha256(title || '|' || coalesce(description, '') || '|' || price_cents || '|' || array_to_string(image_urls, ',')
    || '|' || array_to_string(size_labels, ',')) AS content_hash
FROM listings0""")

# Attributes by construction of the titles, not by pattern rules: an independent check of the extractor.
CTES["extractions"] = (["listings"], f"""
SELECT content_hash, listing_id, CASE WHEN listing_key % 20 = 0 THEN 'manual' ELSE 'mock' END AS model,
  coalesce({pick(LENGTH_CLASSES, 'listing_key % 7')}, CASE WHEN inches < 31.5 THEN 'micro' WHEN inches < 34.5 THEN 'mini'
    WHEN inches < 37.5 THEN 'above_knee' WHEN inches < 41.5 THEN 'knee' WHEN inches < 45.5 THEN 'midi'
    WHEN inches < 51 THEN 'mid_calf' WHEN inches < 57.5 THEN 'maxi' WHEN inches IS NOT NULL THEN 'floor' END)
    AS length_class,
  inches AS length_inches, CASE WHEN inches IS NOT NULL THEN 'stated' END AS length_basis, bust, waist,
  list_filter(CASE WHEN split_part(p_name, ' ', 1) = 'blue' AND (listing_key // 42) % 5 IN (1, 4)
    THEN ['blue', {pick(COLOR_FAMILIES, '(listing_key // 42) % 5')}]
    ELSE [{pick(COLOR_FAMILIES, '(listing_key // 42) % 5')}, CASE split_part(p_name, ' ', 1) WHEN 'red' THEN 'red'
    WHEN 'blue' THEN 'blue' END] END, lambda c: c IS NOT NULL) AS families,
  {pick(FABRIC_TERMS, '(listing_key // 5) % 6')} AS fabric, {pick(FABRIC_HEADS, '(listing_key // 5) % 6')} AS fabric_head,
  CASE WHEN described THEN {pick(NECKS, '(listing_key // 11) % 4')} END AS neckline,
  {pick(SILHOUETTES, '(listing_key // 7) % 6')} AS silhouette,
  {pick(PATTERNS, 'listing_key % 5')} AS worded_pattern,
  CASE WHEN described THEN {pick(OCCASIONS, 'listing_key % 4')} END AS occasion,
  CASE WHEN listing_key % 29 = 0 THEN 'child' END AS audience, first_seen_ms AS extracted_ms
FROM (SELECT *, listing_key % 9 <> 0 AS described,
  CASE WHEN listing_key % 9 <> 0 AND listing_key % 3 = 0 THEN CAST(32 + listing_key % 30 AS DOUBLE) END AS inches,
  CASE WHEN listing_key % 9 <> 0 AND listing_key % 3 = 0 THEN CAST(30 + listing_key % 20 AS DOUBLE) END AS bust,
  CASE WHEN listing_key % 9 <> 0 AND listing_key % 3 = 0 THEN CAST(24 + listing_key % 20 AS DOUBLE) END AS waist
  FROM listings)""")

CTES["attrs"] = (["extractions"], """
SELECT *, coalesce(worded_pattern, CASE WHEN len(families) > 0 THEN 'solid' END) AS pattern,
  least(0.4::DOUBLE, 0.1::DOUBLE + 0.05::DOUBLE * ((length_class IS NOT NULL)::INT + (length_inches IS NOT NULL)::INT
    + (silhouette IS NOT NULL)::INT + (neckline IS NOT NULL)::INT + (fabric IS NOT NULL)::INT
    + (worded_pattern IS NOT NULL)::INT + (len(families) > 0)::INT + (bust IS NOT NULL)::INT)) AS confidence
FROM extractions""")

CTES["tags"] = (["attrs"], """
SELECT listing_id, 'length:' || length_class AS tag, 1.0::DOUBLE AS w FROM attrs WHERE length_class IS NOT NULL
UNION ALL SELECT listing_id, 'silhouette:' || silhouette, 1.0 FROM attrs WHERE silhouette IS NOT NULL
UNION ALL SELECT listing_id, 'color:' || f, 0.8 FROM (SELECT listing_id, unnest(list_distinct(families)) AS f FROM attrs)
UNION ALL SELECT listing_id, 'pattern:' || pattern, 0.7 FROM attrs WHERE pattern <> 'solid'
UNION ALL SELECT listing_id, 'neckline:' || neckline, 0.5 FROM attrs WHERE neckline IS NOT NULL
UNION ALL SELECT listing_id, 'occasion:' || occasion, 0.4 FROM attrs WHERE occasion IS NOT NULL
UNION ALL SELECT listing_id, 'fabric:' || fabric_head, 0.6 FROM attrs WHERE fabric_head IS NOT NULL""")

CTES["users"] = ([], """
SELECT c_custkey AS user_id, CASE WHEN c_custkey % 19 <> 0 THEN CAST(60 + c_custkey % 13 AS DOUBLE) END AS height_inches,
  CAST(c_custkey % 4 AS DOUBLE) AS heel_inches,
  CASE WHEN c_custkey % 11 = 0 THEN CAST([] AS INTEGER[]) ELSE [CAST((c_custkey % 13) * 2 AS INTEGER),
    CAST((c_custkey % 13) * 2 + 2 AS INTEGER)] END AS sizes,
  CASE WHEN c_custkey % 5 = 0 THEN CAST(30 + c_custkey % 10 AS DOUBLE) END AS body_bust,
  CASE WHEN c_custkey % 5 = 0 THEN CAST(24 + c_custkey % 10 AS DOUBLE) END AS body_waist,
  CASE WHEN c_custkey % 5 = 0 THEN CAST(34 + c_custkey % 10 AS DOUBLE) END AS body_hip,
  CASE c_custkey % 3 WHEN 1 THEN ['knee', 'below_knee'] WHEN 2 THEN ['mid_calf', 'ankle', 'floor']
    ELSE CAST([] AS VARCHAR[]) END AS length_prefs,
  CASE WHEN c_custkey % 6 = 0 THEN 60000 END AS budget_min_cents,
  CASE WHEN c_custkey % 3 <> 0 THEN 75000 + greatest(CAST(floor(c_acctbal / 1000) AS BIGINT), 0) * 6000 END AS budget_max_cents,
  CASE WHEN c_custkey % 4 = 0 THEN CAST([] AS VARCHAR[]) ELSE [(['red', 'navy', 'emerald', 'ivory'])[c_custkey % 4 + 1],
    (['red', 'navy', 'emerald', 'ivory'])[(c_custkey + 1) % 4 + 1]] END AS palette,
  CASE WHEN c_custkey % 7 = 0 THEN false WHEN c_custkey % 7 <> 1 THEN true END AS palette_boost_enabled
FROM customer""")

CTES["style_tags"] = ([], """
SELECT user_id, tag, w FROM (SELECT c_custkey AS user_id, unnest(['length:midi', 'silhouette:wrap', 'color:red', 'fabric:silk'])
  AS tag, unnest([((c_custkey % 5) - 2) * 0.4::DOUBLE, ((c_custkey % 7) - 3) * 0.3::DOUBLE,
  ((c_custkey % 3) - 1) * 0.6::DOUBLE, 0.5::DOUBLE]) AS w FROM customer WHERE c_custkey % 9 <> 0)""")

EVENT_LISTING = "'p' || ((event_id * 37 + user_id) % ((SELECT max(p_partkey) + 1 FROM part) * 5 // 4))"
OWNED = "(SELECT *, listing_key % (SELECT max(c_custkey) + 1 FROM customer) AS owner FROM listings)"

CTES["swipes"] = ([], f"""
SELECT event_id AS swipe_id, user_id, {EVENT_LISTING} AS listing_id,
  CASE WHEN event_type IN ('view', 'purchase') THEN 'like' WHEN event_type = 'click' THEN 'save'
    WHEN event_type = 'signup' THEN 'dislike' ELSE 'skip' END AS verdict, epoch_us(ts) // 1000 AS created_ms FROM events""")

CTES["clicks"] = ([], f"""
SELECT event_id AS click_id, {EVENT_LISTING} AS listing_id,
  CASE WHEN event_id % 4 <> 0 THEN user_id END AS user_id, epoch_us(ts) // 1000 AS created_ms
FROM events WHERE event_type = 'click'""")

CTES["analytics"] = ([], f"""
SELECT id, user_id, anon_id, coalesce(user_id, anon_id) AS actor, event_type, created_ms,
  CASE WHEN event_type = 'quiz_step_completed' THEN k % 7 + 1 END AS step,
  CASE WHEN event_type = 'quiz_completed' THEN CAST(floor(value * 1000) AS BIGINT) END AS duration_ms,
  CASE WHEN event_type = 'filter_applied' THEN {pick(['size', 'price', 'length', None], 'k % 4')} END AS kind,
  CASE WHEN event_type = 'deck_swipe' THEN {pick(['like', 'dislike', 'save', 'skip'], 'k % 4')} END AS verdict,
  CASE WHEN event_type = 'search_submitted' THEN
    lower(trim({pick(['Red Midi', ' red midi', 'silk gown', 'Blue wrap', 'linen', 'taffeta ballgown', ''], 'k % 7')})) END AS query,
  CASE WHEN event_type = 'search_submitted' THEN CASE WHEN id % 5 = 0 OR k % 7 = 5 THEN 0 ELSE k END END AS result_count
FROM (SELECT event_id AS id, CASE WHEN event_id % 4 <> 0 THEN CAST(user_id AS VARCHAR) END AS user_id,
    'anon-' || user_id AS anon_id, value, CAST(json_extract(props, '$.k') AS INTEGER) AS k, epoch_us(ts) // 1000 AS created_ms,
    CASE WHEN event_type = 'signup' THEN (['quiz_started', 'quiz_step_completed', 'quiz_completed'])
        [CAST(json_extract(props, '$.k') AS INTEGER) % 3 + 1]
      WHEN event_type = 'click' THEN (['filter_applied', 'deck_swipe'])[CAST(json_extract(props, '$.k') AS INTEGER) % 2 + 1]
      WHEN event_type = 'purchase' THEN 'search_submitted'
      WHEN event_type = 'view' AND CAST(json_extract(props, '$.k') AS INTEGER) % 2 = 0 THEN 'deck_completed'
      ELSE 'feed_viewed' END AS event_type FROM events)""")

CTES["windows"] = ([], f"""
SELECT * FROM (VALUES ('24h', {EVENTS_NOW - DAY}), ('7d', {EVENTS_NOW - 7 * DAY})) AS t(win, since)""")

CTES["windowed"] = (["analytics", "windows"], """
SELECT win, a.* FROM analytics a JOIN windows ON created_ms >= since""")

CTES["errors"] = ([], """
SELECT event_id AS error_id, '/api/' || (['rank', 'search', 'swipes'])[k % 3 + 1] AS route,
  'failed after ' || event_id || ' ms in phase ' || (['read', 'join', 'write', 'send'])[k % 4 + 1] AS message,
  sha256('/api/' || (['rank', 'search', 'swipes'])[k % 3 + 1] || chr(10) || 'failed after # ms in phase '
    || (['read', 'join', 'write', 'send'])[k % 4 + 1] || chr(10)
    || CASE WHEN k % 3 <> 0 THEN 'at handler (app/route.ts' || chr(10) || 'at step' || (k % 4) || ' (lib/x.ts' ELSE '' END)
    AS stack_hash, ts_ms FROM
(SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k, epoch_us(ts) // 1000 AS ts_ms FROM events WHERE event_type = 'error')""")

CTES["vectors"] = (["listings"], """
SELECT CASE WHEN vec_id % 13 = 0 THEN 'old-' || listing_id ELSE content_hash END AS content_hash, listing_id, vec_id,
  embedding AS vector, last_seen_ms AS embedded_ms FROM embeddings JOIN listings ON listing_key = vec_id""")

CTES["runs"] = ([], f"""
SELECT o_orderkey AS run_id, {source_of('(o_custkey % 25)')} AS source_id, epoch_us(o_orderdate) // 1000 AS started_ms,
  CASE o_orderstatus WHEN 'F' THEN 'error' WHEN 'O' THEN 'ok' ELSE 'running' END AS status,
  CAST(floor(o_totalprice / 1000) AS BIGINT) AS fetched, o_orderkey % 7 AS new_rows, o_orderkey % 5 AS errors FROM orders""")


def sql(body: str, *needs: str, **extra: str) -> str:
    """``body`` with the CTEs it needs, dependencies first; ``extra`` adds query-local CTEs in order. {OWNED}: listings with their user."""
    body, extra = body.replace("{OWNED}", OWNED), {name: cte.replace("{OWNED}", OWNED) for name, cte in extra.items()}
    done: list[str] = []

    def add(name: str) -> None:
        if name in done:
            return
        for dep in CTES[name][0]:
            add(dep)
        done.append(name)

    for need in needs:
        add(need)
    parts = [f"{n} AS ({CTES[n][1]})" for n in done] + [f"{n} AS ({q})" for n, q in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
