"""The catalog, user and event relations, derived by Spark from the given parquet tables.

Every relation is a lazy projection or join over whole tables, so work grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garderobe.functions.extraction import EXTRACTED, extract
from garderobe.functions.sizes import normalized_sizes
from garderobe.functions.text import quoted
from garderobe.session import prepare, spread, stage_once
from garderobe.functions.hashing import content_hash

# "Now" of the catalog and of the event feed: fixed literals so results repeat.
CATALOG_NOW_MS = 1005004800000  # 2001-11-06T00:00:00Z
EVENTS_NOW_MS = 1706659200000  # 2024-01-31T00:00:00Z
HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS
MODEL = "vision-64"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


KINDS = ["shopify", "ebay", "jsonld", "fixture"]


def pick(values: list[str | None], index: str) -> str:
    """SQL for the element of a fixed list at a 0-based index; None stands for a missing word."""
    return f"element_at(array({', '.join(quoted(v) for v in values)}), cast(({index}) + 1 as int))"


def source_of(nation: str) -> str:
    return f"concat({pick(KINDS, f'{nation} % 4')}, ':n', {nation})"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").selectExpr(
        f"{source_of('n_nationkey')} as source_id",
        f"{pick(KINDS, 'n_nationkey % 4')} as kind",
        "n_name as display_name",
        f"{pick(['0 */6 * * *', '*/30 * * * *', '0 6 * * *', '0 0 1 * *'], 'n_nationkey % 4')} as cadence_cron",
        "n_nationkey % 5 <> 0 as enabled",
    )


LENGTH_TERMS = ["mini", "midi", "maxi", "knee-length", "floor-length", "micro", None]
SILHOUETTE_TERMS = ["wrap", "slip", "a-line", "bodycon", "shift", None]
COLOR_TERMS = ["navy", "emerald", "ivory", None, "rust"]
FABRIC_TERMS = ["silk", "cotton poplin", "linen", "velvet", None, "jersey knit"]
NECK_TERMS = ["v-neck", "halter", None, "square neck"]
OCCASION_TERMS = ["cocktail", "wedding guest", None, "brunch"]
PATTERN_TERMS = ["floral", None, "polka dot", None, "gingham"]


K = "p_partkey"
TITLE = f"""concat_ws(' ', p_name, {pick(COLOR_TERMS, f'{K} div 42 % 5')}, {pick(PATTERN_TERMS, f'{K} % 5')},
  {pick(FABRIC_TERMS, f'{K} div 5 % 6')}, {pick(SILHOUETTE_TERMS, f'{K} div 7 % 6')}, {pick(LENGTH_TERMS, f'{K} % 7')},
  'dress', if({K} % 29 = 0, 'for girls', null))"""
DESCRIPTION = f"""if({K} % 9 <> 0, concat_ws(' ', 'A piece', 'for ' || {pick(OCCASION_TERMS, f'{K} % 4')},
  'with ' || {pick(NECK_TERMS, f'{K} div 11 % 4')}, if({K} % 3 = 0, concat('Bust: ', 30 + {K} % 20, ' in, waist ',
  24 + {K} % 20, ' in, length: ', 32 + {K} % 30, ' in'), null)), null)"""
SIZE_LABELS = """case p_size % 6 when 0 then array('S', 'M') when 1 then array(cast(p_size as string))
  when 2 then cast(array() as array<string>) when 3 then array('XL', '1X') when 4 then array(concat('US ', p_size % 28))
  else array(concat('0', p_size % 10), 'L+', 'OS') end"""
SOURCE_URL = f"concat('https://store', s_nationkey, '.example.com/products/', {K}, '?utm_source=feed&variant=2')"
IMAGES = f"""transform(slice(array(0, 1, 2), 1, cast({K} % 4 as int)), i -> concat(
  if({K} % 23 = 0, 'https://placehold.co/', 'https://img.example.com/'), {K}, '/', i, '.jpg'))"""
SEEN = f"{CATALOG_NOW_MS} - datediff(date'2001-11-05', _ship) * {HOUR_MS}L"


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog snapshot: parts, their first supplier's nation as source, their last shipment as last sighting."""
    seen = (
        read(spark, sf_dir, "lineitem")
        .groupBy("l_partkey")
        .agg(F.min("l_suppkey").alias("s_suppkey"), F.max("l_shipdate").alias("_ship"))
    )
    part = read(spark, sf_dir, "part")
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    base = spread(part.join(seen, part.p_partkey == seen.l_partkey).join(supplier, "s_suppkey"), K)
    rows = base.selectExpr(
        f"concat('p', {K}) as listing_id",
        f"{K} as listing_key",
        f"{source_of('s_nationkey')} as source_id",
        f"cast({K} as string) as source_listing_id",
        f"{SOURCE_URL} as source_url",
        f"if({K} % 2 = 0, concat({SOURCE_URL}, '&campid=1'), null) as affiliate_url",
        f"{TITLE} as title",
        f"{DESCRIPTION} as description",
        f"if({K} % 31 <> 0, p_brand, null) as brand",
        "cast(round(p_retailprice * 100) as bigint) as price_cents",
        f"{pick(['USD'] * 6 + ['GBP', 'EUR', 'CAD', 'JPY'], f'{K} % 10')} as currency",
        f"{pick(['new', 'like_new', 'good', 'fair', 'unknown'], 'p_size % 5')} as condition",
        f"{K} % 7 = 0 as is_vintage",
        f"{SIZE_LABELS} as size_labels",
        f"{IMAGES} as image_urls",
        f"{SEEN} as last_seen_ms",
        f"if({K} % 17 = 0, {CATALOG_NOW_MS} - ({K} % 100) * {HOUR_MS}, null) as removed_ms",
    )
    return rows.withColumns({
        "first_seen_ms": F.expr(f"last_seen_ms - (listing_key % 30) * {DAY_MS}"),
        "verified_ms": F.expr("if(listing_key % 3 = 0, last_seen_ms, null)"),
        "size_normalized": normalized_sizes(F.col("size_labels")),
        "availability": F.expr("map_from_arrays(size_labels, transform(size_labels, (x, i) -> (listing_key + i) % 3 <> 0))"),
        "content_hash": content_hash(F.col("title"), F.col("description"), F.col("price_cents"), F.col("image_urls"),
                                     F.col("size_labels")),
    })


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with their attributes: the catalog table the ranking plans read.

    Rule extraction runs once per content, so its result is written once and then scanned with pruned columns, instead
    of being inlined into every predicate of every plan.
    """
    return stage_once(spark, "catalog", sf_dir, lambda: extract(listings(spark, sf_dir)))


def extractions(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    """Rule-extracted attributes of every listing, keyed by content hash."""
    return candidates(spark, sf_dir).select(
        "content_hash", "listing_id", F.when(F.col("listing_key") % 20 == 0, "manual").otherwise("mock").alias("model"),
        *EXTRACTED, F.col("first_seen_ms").alias("extracted_ms"),
    )


def listing_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).select("listing_id", F.posexplode("image_urls").alias("position", "url"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    swatches = ("array(named_struct('hex', '#DC143C', 'name', 'red'), named_struct('hex', '#000080', 'name', 'navy'), "
                "named_struct('hex', '#50C878', 'name', 'emerald'), named_struct('hex', '#FFFFF0', 'name', 'ivory'))")
    return read(spark, sf_dir, "customer").selectExpr(
        "c_custkey as user_id",
        "if(c_custkey % 19 <> 0, cast(60 + c_custkey % 13 as double), null) as height_inches",
        "cast(c_custkey % 4 as double) as heel_inches",
        "if(c_custkey % 11 = 0, cast(array() as array<int>), "
        "array(cast(c_custkey % 13 * 2 as int), cast(c_custkey % 13 * 2 + 2 as int))) as sizes",
        "named_struct('bust', if(c_custkey % 5 = 0, cast(30 + c_custkey % 10 as double), null), "
        "'waist', if(c_custkey % 5 = 0, cast(24 + c_custkey % 10 as double), null), "
        "'hip', if(c_custkey % 5 = 0, cast(34 + c_custkey % 10 as double), null)) as body",
        "case c_custkey % 3 when 1 then array('knee', 'below_knee') when 2 then array('mid_calf', 'ankle', 'floor') "
        "else cast(array() as array<string>) end as length_prefs",
        "if(c_custkey % 6 = 0, 60000L, null) as budget_min_cents",
        "if(c_custkey % 3 <> 0, 75000 + greatest(floor(c_acctbal / 1000), 0L) * 6000, null) as budget_max_cents",
        f"if(c_custkey % 4 = 0, slice({swatches}, 1, 0), array(element_at({swatches}, cast(c_custkey % 4 + 1 as int)), "
        f"element_at({swatches}, cast((c_custkey + 1) % 4 + 1 as int)))) as palette",
        "case when c_custkey % 7 = 0 then false when c_custkey % 7 <> 1 then true end as palette_boost_enabled",
        "if(c_custkey % 9 = 0, cast(map() as map<string,double>), map('length:midi', (c_custkey % 5 - 2) * 0.4D, "
        "'silhouette:wrap', (c_custkey % 7 - 3) * 0.3D, 'color:red', (c_custkey % 3 - 1) * 0.6D, 'fabric:silk', 0.5D)) "
        "as style_tags",
    )


def key_count(spark: SparkSession, sf_dir: str, table: str, key: str) -> int:
    """Keys of a table count from 0; one number reaches the driver."""
    return (read(spark, sf_dir, table).agg(F.max(key)).first()[0] or 0) + 1


def event_listing(spark: SparkSession, sf_dir: str) -> str:
    """Listing a given event points at; a fifth of the keys are not in the catalog, as in a real feed."""
    return f"concat('p', (event_id * 37 + user_id) % {key_count(spark, sf_dir, 'part', 'p_partkey') * 5 // 4})"


EVENT_TIMES = ["unix_millis(cast(ts as timestamp)) as created_ms", "cast(ts as timestamp) as ts"]
PROP_K = "cast(get_json_object(props, '$.k') as int)"


def swipes(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    events = read(spark, sf_dir, "events") if events is None else events
    return events.selectExpr(
        "event_id as swipe_id", "user_id", f"{event_listing(spark, sf_dir)} as listing_id",
        "case when event_type in ('view', 'purchase') then 'like' when event_type = 'click' then 'save' "
        "when event_type = 'signup' then 'dislike' else 'skip' end as verdict",
        *EVENT_TIMES,
    )


def clicks(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Raw outbound clicks: (click_id, listing_id, user_id, created_ms)."""
    events = read(spark, sf_dir, "events") if events is None else events
    return events.filter("event_type = 'click'").selectExpr(
        "event_id as click_id", f"{event_listing(spark, sf_dir)} as listing_id", "if(event_id % 4 <> 0, user_id, null) as user_id",
        *EVENT_TIMES,
    )


QUERY_WORDS = ["Red Midi", " red midi", "silk gown", "Blue wrap", "linen", "taffeta ballgown", ""]
FILTER_KINDS = ["size", "price", "length", None]
VERDICT_WORDS = ["like", "dislike", "save", "skip"]
SIGNUP_STEPS = ["quiz_started", "quiz_step_completed", "quiz_completed"]


def analytics_events(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Typed analytics events with JSON props, in the shape the event feed has."""
    events = read(spark, sf_dir, "events") if events is None else events
    typed = events.withColumn("k", F.expr(PROP_K)).withColumn("kind", F.expr(f"""case
        when event_type = 'signup' then {pick(SIGNUP_STEPS, 'k % 3')}
        when event_type = 'click' then if(k % 2 = 0, 'filter_applied', 'deck_swipe')
        when event_type = 'purchase' then 'search_submitted'
        when event_type = 'view' and k % 2 = 0 then 'deck_completed' else 'feed_viewed' end"""))
    props = f"""case kind when 'quiz_started' then '{{}}' when 'deck_completed' then '{{}}'
        when 'quiz_step_completed' then to_json(named_struct('step', k % 7 + 1))
        when 'quiz_completed' then to_json(named_struct('durationMs', floor(value * 1000)))
        when 'filter_applied' then to_json(named_struct('kind', {pick(FILTER_KINDS, 'k % 4')}))
        when 'deck_swipe' then to_json(named_struct('verdict', {pick(VERDICT_WORDS, 'k % 4')}, 'index', k % 100))
        when 'search_submitted' then to_json(named_struct('query', {pick(QUERY_WORDS, 'k % 7')},
          'resultCount', if(event_id % 5 = 0 or k % 7 = 5, 0, k), 'interpreted', true))
        else to_json(named_struct('page', k % 10)) end"""
    return typed.selectExpr(
        "event_id as id", "if(event_id % 4 <> 0, cast(user_id as string), null) as user_id",
        "concat('anon-', user_id) as anon_id", "kind as event_type", f"{props} as props", *EVENT_TIMES,
    )


def error_events(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    events = read(spark, sf_dir, "events") if events is None else events
    return events.filter("event_type = 'error'").withColumn("k", F.expr(PROP_K)).selectExpr(
        "event_id as error_id",
        f"concat('/api/', {pick(['rank', 'search', 'swipes'], 'k % 3')}) as route",
        f"concat('failed after ', event_id, ' ms in phase ', {pick(['read', 'join', 'write', 'send'], 'k % 4')}) as message",
        "if(k % 3 <> 0, concat('Error: boom\\n    at handler (app/route.ts:', event_id % 50, ':7)\\n  at step', k % 4, "
        "' (lib/x.ts:3)\\ndone'), null) as stack",
        "unix_millis(cast(ts as timestamp)) as ts_ms", "cast(ts as timestamp) as ts",
    )


def embeddings(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    """Vector table keyed by (content hash, model); every thirteenth row carries an outdated hash."""
    base = listings(spark, sf_dir) if base is None else base
    vectors = read(spark, sf_dir, "embeddings")
    keys = base.select("listing_key", "listing_id", F.col("content_hash").alias("_hash"), "last_seen_ms")
    return vectors.join(keys, vectors.vec_id == keys.listing_key).select(
        F.when(F.col("vec_id") % 13 == 0, F.concat(F.lit("old-"), "listing_id")).otherwise(F.col("_hash"))
        .alias("content_hash"),
        F.lit(MODEL).alias("model"),
        "listing_id",
        F.size("embedding").alias("dim"),
        F.col("embedding").alias("vector"),
        F.col("last_seen_ms").alias("embedded_ms"),
    )


def ingest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run log: one run per order; the order's totals stand for the run's counters."""
    return read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as run_id",
        f"{source_of('(o_custkey % 25)')} as source_id",
        "unix_millis(cast(o_orderdate as timestamp)) as started_ms",
        "unix_millis(cast(o_orderdate as timestamp)) + 60000 as finished_ms",
        "case o_orderstatus when 'F' then 'error' when 'O' then 'ok' else 'running' end as status",
        "to_json(named_struct('fetched', floor(o_totalprice / 1000), 'new', o_orderkey % 7, 'errors', o_orderkey % 5)) "
        "as stats",
    )
