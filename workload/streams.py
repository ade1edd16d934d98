"""Streams over the given event files, run to the end of the input and compared with their batch meaning."""

from pyspark.sql import functions as F

from garderobe.sources import tables as T
from garderobe.streaming import jobs
from garderobe.streaming.runtime import file_stream, to_table
from workload.bindings import DAY, HOUR, NOW, sql
from workload.maintenance import BATCH_MS, GROUPS, HOURS, ORD, SNAP, batch, snapshot
from workload.ranking import fold_sql
from garderobe.session import scratch_path
from workload.registry import query


def feed(spark, d):
    return file_stream(spark, d, "events.parquet")


@query("stream_error_hours", sql(f"SELECT stack_hash, ts_ms // {HOUR} * {HOUR} AS hour_ms, count(*) AS n, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM errors GROUP BY ALL", "errors"))
def _(spark, d):
    return jobs.error_hours(T.error_events(spark, d, feed(spark, d)))


@query("stream_error_totals", sql("SELECT stack_hash, count, first_seen_ms, last_seen_ms, hour_count FROM h", "errors", g=GROUPS, h=HOURS))
def _(spark, d):
    return jobs.error_totals(jobs.error_hours(T.error_events(spark, d, feed(spark, d))))


@query("stream_error_spikes", sql(f"""SELECT s * {HOUR} AS start_ms, (s + 2) * {HOUR} AS end_ms, count(*) AS n FROM (SELECT unnest([ts_ms // {HOUR}, ts_ms // {HOUR} - 1]) AS s FROM errors)
  GROUP BY s HAVING count(*) >= 5""", "errors"))
def _(spark, d):
    return jobs.error_spikes(T.error_events(spark, d, feed(spark, d)), 5)


@query("stream_style_vectors", fold_sql({"like": 0.15, "save": 0.25, "dislike": -0.15, "skip": -0.03}, 1, 0.005))
def _(spark, d):
    state = jobs.style_vectors(T.swipes(spark, d, feed(spark, d)), T.candidates(spark, d))
    return state.select("user_id", "tag", F.round("value", 6).alias("value"))


@query("stream_valid_events", sql("""SELECT event_type, user_id IS NOT NULL AS known_user, count(*) AS n FROM analytics WHERE NOT (event_type = 'filter_applied' AND kind IS NULL)
  AND NOT (event_type = 'search_submitted' AND query = '') GROUP BY ALL""", "analytics"))
def _(spark, d):
    valid, _ = jobs.attributed_events(T.analytics_events(spark, d, feed(spark, d)), T.users(spark, d))
    return to_table(valid, "valid").groupBy("event_type", "known_user").agg(F.count(F.lit(1)).alias("n"))


@query("stream_rolling_counts", sql(f"""SELECT (created_ms // {DAY} + i) * {DAY} AS end_ms, event_type, count(*) AS n, count(DISTINCT coalesce(user_id, anon_id)) AS actors, 0 AS outside FROM (SELECT *, unnest(range(1, 8)) AS i FROM analytics) GROUP BY ALL""", "analytics"))
def _(spark, d):
    """``actors`` are counted from the events; ``outside`` says how many windows' sketched actors lie more than three standard errors off."""
    events = T.analytics_events(spark, d)
    sketched = jobs.rolling_actors(T.analytics_events(spark, d, feed(spark, d)))
    ends = F.explode(F.sequence(F.lit(1), F.lit(jobs.PANES)))
    counted = events.withColumn("i", ends).groupBy(((F.floor(F.unix_millis("ts") / DAY) + F.col("i")) * DAY).alias("end_ms"), "event_type").agg(F.count_distinct(F.coalesce("user_id", "anon_id")).alias("exact"))
    off = F.abs(F.col("actors") - F.col("exact")) > F.greatest(F.col("exact") * (3 * 1.04 / 2 ** (jobs.SKETCH_BITS / 2)), F.lit(0.5))
    return sketched.join(counted, ["end_ms", "event_type"], "left").select("end_ms", "event_type", "n", F.col("exact").alias("actors"), F.coalesce(off, F.lit(True)).cast("int").alias("outside"))


@query("stream_clickouts", sql("SELECT click_id, user_id, source_id, sha256(coalesce(affiliate_url, source_url)) AS destination_hash FROM clicks JOIN listings USING (listing_id)", "clicks", "listings"))
def _(spark, d):
    return jobs.clickout_log(T.clicks(spark, d, feed(spark, d)), T.listings(spark, d)).select("click_id", "user_id", "source_id", "destination_hash")


@query("stream_recheck_queue", sql("SELECT DISTINCT listing_id, 'clickout' AS reason FROM clicks JOIN listings USING (listing_id)", "clicks", "listings"))
def _(spark, d):
    return jobs.recheck_queue(T.clicks(spark, d, feed(spark, d)), T.listings(spark, d)).select("listing_id", "reason").distinct()


@query("stream_catalog_feed", sql("SELECT listing_id, price_cents, last_seen_ms FROM snap", ord=ORD, snap=SNAP))
def _(spark, d):
    path = scratch_path(spark, "feed")
    batch(spark, d).write.parquet(path)
    after = jobs.catalog_feed(file_stream(spark, path, "*.parquet", 2), snapshot(spark, d))
    return after.select("listing_id", "price_cents", "last_seen_ms")


@query("stream_accepted_hits", f"""WITH RECURSIVE h AS (SELECT user_id AS key, event_id AS hit_id, epoch_us(ts) // 1000 AS at_ms FROM events),
  n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY at_ms, hit_id) AS nth FROM h),
  walk AS (SELECT key, hit_id, at_ms, nth, true AS accepted, [at_ms] AS kept FROM n WHERE nth = 1
    UNION ALL SELECT key, hit_id, at_ms, nth, len(recent) < 2, CASE WHEN len(recent) < 2 THEN recent || [at_ms] ELSE recent END FROM
      (SELECT n.*, list_filter(walk.kept, lambda t: t > n.at_ms - {6 * HOUR}) AS recent FROM walk JOIN n ON n.key IS NOT DISTINCT FROM walk.key AND n.nth = walk.nth + 1))
  SELECT key, hit_id, at_ms, accepted FROM walk""")
def _(spark, d):
    hits = feed(spark, d).selectExpr("user_id as key", "event_id as hit_id", "unix_millis(cast(ts as timestamp)) as at_ms", "cast(ts as timestamp) as ts")
    return jobs.accepted_hits(hits, 2, 6 * HOUR).select("key", "hit_id", "at_ms", "accepted")


@query("stream_deck_completions", sql("""SELECT user_id, CASE WHEN likes >= 5 THEN 'target' ELSE 'cap' END AS reason, created_ms AS at_ms, likes AS positives, n AS cards FROM (SELECT *, row_number() OVER
  (PARTITION BY user_id ORDER BY n) AS first FROM (SELECT user_id, created_ms, count(*) OVER w AS n, count(*) FILTER (verdict IN ('like', 'save')) OVER w AS likes FROM swipes
  WINDOW w AS (PARTITION BY user_id ORDER BY created_ms, swipe_id ROWS UNBOUNDED PRECEDING)) WHERE likes >= 5 OR n >= 30) WHERE first = 1""", "swipes"))
def _(spark, d):
    return jobs.deck_completions(T.swipes(spark, d, feed(spark, d))).drop("batch")


@query("stream_stale_sources", sql(f"""SELECT source_id, last_ok_ms FROM (SELECT source_id, max(started_ms) AS last_ok_ms FROM runs JOIN sources USING (source_id) WHERE enabled AND status = 'ok' GROUP BY source_id)
  WHERE {NOW} - last_ok_ms > 30 * {HOUR}""", "runs", "sources"))
def _(spark, d):
    runs = file_stream(spark, d, "orders.parquet").selectExpr(
        f"{T.source_of('(o_custkey % 25)')} as source_id", "unix_millis(cast(o_orderdate as timestamp)) as started_ms",
        "case o_orderstatus when 'F' then 'error' when 'O' then 'ok' else 'running' end as status")
    return jobs.stale_sources(jobs.last_success(runs), T.sources(spark, d), NOW)
