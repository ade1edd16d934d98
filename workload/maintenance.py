"""Snapshot upserts, work queues, verification, corrections, profiles, clean-ups and error groups."""

from pyspark.sql import functions as F

from garderobe.functions import audience as AU
from garderobe.functions import brands as B
from garderobe.functions import extraction as X
from garderobe.functions.coerce import coerced
from garderobe.operators.joins import first_images
from garderobe.plans import cleanup, errors, extract, ingest, lengths, profiles, reconcile, verify
from garderobe.session import spread
from garderobe.sources import tables as T
from workload.bindings import DAY, EVENT_LISTING, HOUR, NOW, pick, source_of, sql
from workload.registry import query

BATCH_MS = 996624000000  # 2001-08-01


def order_rows(spark, d):
    """Orders read as listings of the customer's nation."""
    return T.read(spark, d, "orders").selectExpr(
        f"{T.source_of('(o_custkey % 25)')} as source_id", "cast(o_orderkey as string) as source_listing_id", "o_orderkey as k",
        "concat('https://shop.example.com/p/', o_orderkey) as source_url", "cast(null as string) as affiliate_url",
        "o_orderpriority as title", "cast(null as string) as description", "cast(null as string) as brand",
        "cast(round(o_totalprice * 100) as bigint) as price_cents", "'USD' as currency", "'new' as condition", "false as is_vintage",
        "cast(null as string) as era", "if(o_orderkey % 2 = 0, array('S', 'M'), array('8')) as size_labels",
        "array(concat('https://img.example.com/', o_orderkey)) as image_urls", "unix_millis(cast(o_orderdate as timestamp)) as day_ms")


def snapshot(spark, d):
    rows = order_rows(spark, d).filter("day_ms < unix_millis(timestamp'1999-07-01 00:00:00')")
    return ingest.hashed(rows).withColumns({
        "size_normalized": F.when(F.col("k") % 6 == 0, F.array(F.lit(4))).otherwise(F.expr("if(k % 2 = 0, array(4, 6, 8, 10), array(8))")),
        "availability": F.expr("map_from_arrays(size_labels, transform(size_labels, x -> true))"),
        "first_seen_ms": F.col("day_ms"), "last_seen_ms": F.col("day_ms"),
        "removed_ms": F.expr("if(k % 10 = 0, day_ms, null)"), "verified_ms": F.lit(None).cast("long"),
    }).drop("k", "day_ms")


def batch(spark, d):
    rows = order_rows(spark, d).filter("day_ms >= unix_millis(timestamp'1998-01-01 00:00:00')").withColumns({
        "price_cents": F.expr("if(k % 4 = 0, price_cents + 100, price_cents)"),
        "title": F.expr("if(k % 50 = 0, ' ', title)"),
        "availability": F.expr("map_from_arrays(size_labels, transform(size_labels, x -> k % 3 <> 0))"),
        "seen_ms": F.lit(BATCH_MS),
        "ordinal": F.col("k"),
    })
    again = rows.filter("k % 20 = 1").withColumns({"ordinal": F.col("k") + 10_000_000_000, "title": F.lit("seen twice")})
    return rows.unionByName(again).drop("k", "day_ms")


ORD = f"""SELECT *, {source_of('(o_custkey % 25)')} AS source_id, {source_of('(o_custkey % 25)')} || ':' || o_orderkey AS listing_id,
  epoch_us(o_orderdate) // 1000 AS day_ms, CAST(round(o_totalprice * 100) AS BIGINT) AS price, o_orderdate < '1999-07-01' AS old,
  o_orderdate >= '1998-01-01' AND o_orderkey % 50 <> 0 AS fresh FROM orders"""
SNAP = f"""SELECT *, CASE WHEN NOT fresh THEN 'absent' WHEN NOT old THEN 'new' WHEN o_orderkey % 4 = 0 THEN 'updated' ELSE 'unchanged' END AS change,
  CASE WHEN fresh AND o_orderkey % 4 = 0 THEN price + 100 ELSE price END AS price_cents, CASE WHEN old THEN day_ms ELSE {BATCH_MS} END AS first_seen_ms,
  CASE WHEN fresh THEN {BATCH_MS} ELSE day_ms END AS last_seen_ms, CASE WHEN NOT fresh AND o_orderkey % 10 = 0 THEN day_ms END AS removed_ms,
  CASE WHEN o_orderkey % 6 = 0 AND NOT (fresh AND (NOT old OR o_orderkey % 4 = 0)) THEN '4' WHEN o_orderkey % 2 = 0 THEN '4,6,8,10' ELSE '8' END AS sizes,
  CASE WHEN fresh THEN o_orderkey % 3 <> 0 ELSE true END AS stocked FROM ord WHERE old OR fresh"""


@query("snapshot_upsert", sql("SELECT listing_id, change, price_cents, first_seen_ms, last_seen_ms, removed_ms, sizes, stocked FROM snap", ord=ORD, snap=SNAP))
def _(spark, d):
    valid, _ = ingest.split_valid(batch(spark, d))
    after = ingest.next_snapshot(snapshot(spark, d), ingest.hashed(ingest.first_of_each(valid)))
    return after.select("listing_id", "change", "price_cents", "first_seen_ms", "last_seen_ms", "removed_ms",
                        F.array_join(F.col("size_normalized").cast("array<string>"), ",").alias("sizes"),
                        F.forall(F.map_values("availability"), lambda v: v).alias("stocked"))


@query("ingest_run_stats", sql("SELECT change, count(*) AS n FROM snap WHERE change <> 'absent' GROUP BY change", ord=ORD, snap=SNAP))
def _(spark, d):
    after, _ = ingest.ingest_snapshot(snapshot(spark, d), batch(spark, d), T.sources(spark, d), BATCH_MS)
    return ingest.run_stats(after)


@query("ingest_rejects", sql("SELECT 'title' AS reason, count(*) AS n FROM orders WHERE o_orderdate >= '1998-01-01' AND o_orderkey % 50 = 0"))
def _(spark, d):
    _, rejects = ingest.split_valid(batch(spark, d))
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("explicit_removals", sql(f"SELECT listing_id, CASE WHEN o_orderkey % 13 = 0 THEN {BATCH_MS} ELSE removed_ms END AS removed_ms FROM snap",
                                ord=ORD, snap=SNAP))
def _(spark, d):
    valid, _ = ingest.split_valid(batch(spark, d))
    after = ingest.next_snapshot(snapshot(spark, d), ingest.hashed(ingest.first_of_each(valid)))
    gone = order_rows(spark, d).filter("k % 13 = 0").select("source_id", "source_listing_id")
    return ingest.apply_removals(after, gone, BATCH_MS).select("listing_id", "removed_ms")


CADENCE = f"CASE cadence_cron WHEN '0 */6 * * *' THEN 6 * {HOUR} WHEN '*/30 * * * *' THEN 1800000 WHEN '0 6 * * *' THEN {DAY} ELSE 7 * {DAY} END"


@query("cron_intervals", sql(f"SELECT source_id, {CADENCE} AS interval_ms FROM sources", "sources"))
def _(spark, d):
    return T.sources(spark, d).select("source_id", ingest.cron_interval_ms(F.col("cadence_cron")).alias("interval_ms"))


@query("stale_pruned", sql(f"""SELECT source_id, count(*) AS n FROM listings JOIN sources USING (source_id) WHERE removed_ms IS NULL
  AND last_seen_ms < {NOW} - 2 * ({CADENCE}) GROUP BY source_id""", "listings", "sources"))
def _(spark, d):
    rows = ingest.prune_stale(T.listings(spark, d), T.sources(spark, d), NOW)
    return rows.filter("pruned").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


@query("images_replaced", sql("""SELECT listing_id, i - 1 AS position, CASE WHEN listing_key % 5 = 0 THEN 'https://new.example.com/' || listing_id ELSE
  image_urls[i] END AS url FROM (SELECT *, unnest(range(1, CASE WHEN listing_key % 5 = 0 THEN 2 ELSE len(image_urls) + 1 END)) AS i FROM listings)""",
                              "listings"))
def _(spark, d):
    changed = T.listings(spark, d).filter(F.col("listing_key") % 5 == 0).select(
        "listing_id", F.array(F.concat(F.lit("https://new.example.com/"), "listing_id")).alias("image_urls"))
    return ingest.replace_images(T.listing_images(spark, d), changed).withColumn("position", F.col("position").cast("long"))


@query("run_log_totals", sql("SELECT CAST(sum(fetched) AS BIGINT) AS fetched, CAST(sum(new_rows) AS BIGINT) AS \"new\", CAST(sum(errors) AS BIGINT) AS errors, "
                             "bool_or(status = 'ok') AS ok FROM runs", "runs"))
def _(spark, d):
    return ingest.total_stats(T.ingest_runs(spark, d))


@query("vector_upsert", sql("""SELECT listing_id, content_hash, CASE WHEN vec_id % 4 = 0 THEN 1 ELSE embedded_ms END AS embedded_ms FROM vectors""", "vectors"))
def _(spark, d):
    have = T.embeddings(spark, d)
    new = have.filter(F.substring("listing_id", 2, 20).cast("long") % 4 == 0).withColumn("embedded_ms", F.lit(1).cast("long"))
    return ingest.upsert_vectors(have, new).select("listing_id", "content_hash", "embedded_ms")


@query("protected_upsert", sql("""SELECT listing_id, CASE WHEN model = 'manual' THEN 'manual' ELSE 'vision' END AS model FROM attrs""", "attrs"))
def _(spark, d):
    have = T.extractions(spark, d)
    new = have.withColumns({"model": F.lit("vision"), "extracted_ms": F.col("extracted_ms") + 1})
    stray = new.withColumn("content_hash", F.concat(F.lit("stray-"), "content_hash"))
    return extract.protected_upsert(have, new.unionByName(stray), T.listings(spark, d)).select("listing_id", "model")


@query("corrections_applied", sql("""SELECT listing_id, CASE WHEN hit THEN 'manual' ELSE model END AS model, CASE WHEN hit THEN 'floor' ELSE length_class END
  AS length_class, CASE WHEN NOT hit THEN fabric END AS fabric, CASE WHEN hit THEN 99.0 ELSE bust END AS bust, waist
FROM (SELECT *, CAST(substring(listing_id, 2) AS BIGINT) % 10 = 3 AS hit FROM attrs)""", "attrs"))
def _(spark, d):
    have = T.extractions(spark, d)
    patch = have.filter(F.substring("listing_id", 2, 20).cast("long") % 10 == 3).select(
        "content_hash", F.array(F.lit("length_class"), F.lit("fabric")).alias("fields"), F.lit("floor").alias("length_class"),
        F.lit(None).cast("string").alias("fabric"), *[F.col(c) for c in ("length_inches", "neckline", "silhouette", "sleeve", "pattern", "confidence")],
        F.create_map(F.lit("bust"), F.lit(99.0)).alias("measurements"))
    after, _ = extract.apply_corrections(have, patch)
    return after.select("listing_id", "model", "length_class", "fabric", F.col("measurements.bust").alias("bust"), F.col("measurements.waist").alias("waist"))


@query("correction_log", sql("""SELECT listing_id, length_class AS before, 'floor' AS after FROM attrs WHERE CAST(substring(listing_id, 2) AS BIGINT) % 10 = 3""",
                             "attrs"))
def _(spark, d):
    have = T.extractions(spark, d)
    patch = have.filter(F.substring("listing_id", 2, 20).cast("long") % 10 == 3).select(
        "content_hash", F.array(F.lit("length_class")).alias("fields"), F.lit("floor").alias("length_class"),
        *[F.col(c) for c in ("fabric", "length_inches", "neckline", "silhouette", "sleeve", "pattern", "confidence")],
        F.lit(None).cast("map<string,double>").alias("measurements"))
    _, log = extract.apply_corrections(have, patch)
    return log.select("listing_id", F.col("before.length_class").alias("before"), F.col("after.length_class").alias("after"))


@query("measurements_reconciled", sql("""SELECT listing_id, CASE WHEN bust IS NULL THEN said WHEN abs(said - bust) > 1.5 THEN bust ELSE said END AS bust
FROM (SELECT listing_id, bust, 36.0::DOUBLE AS said FROM attrs)""", "attrs"))
def _(spark, d):
    rule = T.extractions(spark, d)
    said = rule.withColumn("measurements", F.struct(F.lit(36.0).alias("bust"), F.lit(None).cast("double").alias("waist"),
                                                    F.lit(None).cast("double").alias("hip"), F.lit(None).cast("double").alias("length")))
    return extract.reconcile(said, rule).select("listing_id", F.col("measurements.bust").alias("bust"))


@query("extraction_accuracy", sql(f"""SELECT field, count(truth) AS n, avg(CASE WHEN truth IS NULL THEN NULL WHEN truth IS NOT DISTINCT FROM found THEN 1.0 ELSE 0.0 END) AS accuracy FROM
  (SELECT unnest(['length_class', 'silhouette', 'fabric']) AS field, unnest([t_l, t_s, t_f]) AS truth, unnest([length_class, silhouette, fabric]) AS found
   FROM (SELECT a.*, {pick(['mini', 'midi', 'maxi', 'knee', 'floor', 'micro', 'knee'], 'CAST(substring(listing_id, 2) AS BIGINT) % 7')} AS t_l,
    CASE WHEN CAST(substring(listing_id, 2) AS BIGINT) % 2 = 0 THEN silhouette END AS t_s, coalesce(fabric, 'lace') AS t_f FROM attrs a)) GROUP BY field""", "attrs"))
def _(spark, d):
    have = T.extractions(spark, d)
    k = "cast(substring(listing_id, 2) as bigint)"
    truth = have.selectExpr("listing_id", f"{T.pick(['mini', 'midi', 'maxi', 'knee', 'floor', 'micro', 'knee'], k + ' % 7')} as length_class",
                            f"if({k} % 2 = 0, silhouette, null) as silhouette", "coalesce(fabric, 'lace') as fabric")
    return extract.accuracy(have, truth, ["length_class", "silhouette", "fabric"])


# --- verification ----------------------------------------------------------------------------------------------
def observations(spark, d):
    k = "listing_key"
    return T.listings(spark, d).filter(f"{k} % 2 = 0").selectExpr(
        "listing_id", f"case when {k} % 12 = 0 then 404 when {k} % 12 = 6 then 503 else 200 end as http_status",
        f"case when {k} % 10 = 2 then transform_values(availability, (x, v) -> false) when {k} % 10 = 4 then transform_values(availability, (x, v) -> true) "
        f"when {k} % 10 = 8 then availability end as seen",
        f"case when {k} % 8 = 0 then 'out_of_stock' when {k} % 8 = 4 then 'in_stock' end as explicit_stock")


OUTCOME = """SELECT listing_id, listing_key, removed_ms, CASE WHEN removed_ms IS NOT NULL THEN 'ok' WHEN k % 12 = 0 THEN 'gone' WHEN k % 12 = 6 THEN 'inconclusive'
  WHEN n > 0 AND k % 10 = 2 THEN 'sold_out' WHEN n > 0 AND k % 10 = 4 AND NOT all_in THEN 'availability_updated'
  WHEN n > 0 AND k % 10 = 8 AND NOT any_in THEN 'sold_out' WHEN n > 0 AND k % 10 IN (4, 8) THEN 'ok'
  WHEN k % 8 = 0 THEN 'sold_out' WHEN k % 8 = 4 THEN 'ok' ELSE 'inconclusive' END AS outcome FROM (SELECT listing_id, listing_key, removed_ms, listing_key AS k,
  len(size_labels) AS n, len(list_filter(range(len(size_labels)), lambda i: (listing_key + i) % 3 = 0)) = 0 AS all_in,
  len(list_filter(range(len(size_labels)), lambda i: (listing_key + i) % 3 <> 0)) > 0 AS any_in FROM listings WHERE listing_key % 2 = 0)"""


@query("verification_outcomes", sql("SELECT listing_id, outcome FROM o", "listings", o=OUTCOME))
def _(spark, d):
    return verify.outcomes(T.listings(spark, d), observations(spark, d)).select("listing_id", "outcome")


@query("verification_counts", sql("SELECT outcome, count(*) AS n FROM o GROUP BY outcome", "listings", o=OUTCOME))
def _(spark, d):
    return verify.outcome_counts(verify.outcomes(T.listings(spark, d), observations(spark, d)))


@query("verified_snapshot", sql(f"""SELECT listing_id, CASE WHEN o.listing_id IS NOT NULL AND outcome IN ('gone', 'sold_out') THEN {NOW} ELSE l.removed_ms END AS removed_ms,
  CASE WHEN o.listing_id IS NOT NULL AND outcome <> 'inconclusive' AND l.removed_ms IS NULL THEN {NOW} ELSE verified_ms END AS verified_ms,
  array_to_string(CASE WHEN o.listing_id IS NOT NULL AND l.removed_ms IS NULL AND outcome IN ('ok', 'availability_updated') AND len(size_labels) > 0
    AND l.listing_key % 10 = 8 THEN instock WHEN o.listing_id IS NOT NULL AND outcome = 'availability_updated' THEN size_normalized
    ELSE size_normalized END, ',') AS sizes FROM listings l LEFT JOIN o USING (listing_id) LEFT JOIN ins USING (listing_id)""", "listings", o=OUTCOME, ins="""
SELECT listing_id, list_sort(list_distinct(flatten(list(one)))) AS instock FROM (SELECT listing_id, CASE WHEN lbl = 'S' THEN [4, 6] WHEN lbl = 'M' THEN [8, 10]
  WHEN lbl = 'XL' THEN [16] WHEN lbl = '1X' THEN [16, 18] WHEN lbl = 'L+' THEN [12, 14] WHEN lbl = 'OS' THEN [] WHEN n > 26 THEN [] WHEN n % 2 = 0 THEN [n]
  ELSE [n - 1, n + 1] END AS one FROM (SELECT listing_id, listing_key, i, lbl, TRY_CAST(replace(lbl, 'US ', '') AS INTEGER) AS n FROM
  (SELECT listing_id, listing_key, unnest(size_labels) AS lbl, unnest(range(len(size_labels))) AS i FROM listings)) WHERE (listing_key + i) % 3 <> 0) GROUP BY listing_id"""))
def _(spark, d):
    l = T.listings(spark, d)
    after = verify.apply_outcomes(l, verify.outcomes(l, observations(spark, d)), NOW)
    return after.select("listing_id", "removed_ms", "verified_ms", F.array_join(F.col("size_normalized").cast("array<string>"), ",").alias("sizes"))


def requests(spark, d):
    return T.clicks(spark, d).select("listing_id", F.when(F.col("click_id") % 5 == 0, "manual").otherwise("clickout").alias("reason"),
                                     F.col("created_ms").alias("enqueued_ms"), "click_id")


QUEUE = """SELECT listing_id, arg_min(CASE WHEN click_id % 5 = 0 THEN 'manual' ELSE 'clickout' END, created_ms) AS reason, min(created_ms) AS enqueued_ms FROM clicks
  JOIN listings USING (listing_id) WHERE removed_ms IS NULL AND (source_id LIKE 'shopify:%' OR source_id LIKE 'jsonld:%') GROUP BY listing_id"""


@query("verification_queue", sql("SELECT * FROM q", "clicks", "listings", q=QUEUE))
def _(spark, d):
    return verify.enqueue(requests(spark, d), T.listings(spark, d))


@query("verification_queue_head", sql("SELECT listing_id, enqueued_ms FROM q ORDER BY enqueued_ms, listing_id LIMIT 25", "clicks", "listings", q=QUEUE))
def _(spark, d):
    return verify.queue_head(verify.enqueue(requests(spark, d), T.listings(spark, d)), 25).select("listing_id", "enqueued_ms")


@query("verification_dequeued", sql("SELECT count(*) AS n FROM (SELECT listing_id FROM q ORDER BY enqueued_ms, listing_id OFFSET 25)", "clicks", "listings", q=QUEUE))
def _(spark, d):
    q = verify.enqueue(requests(spark, d), T.listings(spark, d))
    return verify.dequeue(q, verify.queue_head(q, 25)).agg(F.count(F.lit(1)).alias("n"))


# --- lengths ---------------------------------------------------------------------------------------------------
def estimated(spark, d):
    """Extractions with estimate bookkeeping derived from the listing key."""
    k = "cast(substring(listing_id, 2) as bigint)"
    return T.extractions(spark, d).withColumns({
        "length_basis": F.expr(f"case when {k} % 5 = 1 then 'image_estimate' when {k} % 5 = 2 then 'not_estimable' else length_basis end"),
        "length_inches": F.expr(f"case when {k} % 5 = 1 and {k} % 2 = 0 then 40.0D when {k} % 5 in (1, 2) then null else length_inches end"),
        "length_anchor": F.expr(f"case when {k} % 5 = 1 and {k} % 3 = 0 then 'assumed_default' when {k} % 5 = 1 and {k} % 3 = 1 then 'stated_model_height' end"),
        "length_anchor_height": F.expr(f"if({k} % 5 = 1, 69.0D, null)"),
    })


EST = """SELECT listing_id, content_hash, model, k, length_class, CASE WHEN k % 5 = 1 THEN 'image_estimate' WHEN k % 5 = 2 THEN 'not_estimable' ELSE length_basis END AS length_basis,
  CASE WHEN k % 5 = 1 AND k % 2 = 0 THEN 40.0 WHEN k % 5 IN (1, 2) THEN NULL ELSE length_inches END AS length_inches
  FROM (SELECT *, CAST(substring(listing_id, 2) AS BIGINT) AS k FROM attrs)"""


@query("requeue_preview", sql("SELECT count(*) AS n FROM e WHERE length_basis = 'not_estimable' AND model <> 'manual'", "attrs", e=EST))
def _(spark, d):
    return lengths.count_requeue(estimated(spark, d))


@query("requeued_lengths", sql("SELECT coalesce(length_basis, '-') AS basis, count(*) AS n FROM (SELECT CASE WHEN length_basis = 'not_estimable' AND model <> 'manual' "
                               "THEN NULL ELSE length_basis END AS length_basis FROM e) GROUP BY ALL", "attrs", e=EST))
def _(spark, d):
    return lengths.requeue_not_estimable(estimated(spark, d)).groupBy(F.coalesce("length_basis", F.lit("-")).alias("basis")).agg(F.count(F.lit(1)).alias("n"))


@query("length_bookkeeping", sql("SELECT coalesce(length_basis, '-') AS basis, count(*) AS n FROM (SELECT CASE WHEN length_basis = 'image_estimate' AND length_inches IS NULL "
                                 "THEN 'not_estimable' ELSE length_basis END AS length_basis FROM e) GROUP BY ALL", "attrs", e=EST))
def _(spark, d):
    return lengths.migrate_bookkeeping(estimated(spark, d)).groupBy(F.coalesce("length_basis", F.lit("-")).alias("basis")).agg(F.count(F.lit(1)).alias("n"))


BANDS = """CASE length_class WHEN 'micro' THEN [20, 31.5] WHEN 'mini' THEN [31.5, 34.5] WHEN 'above_knee' THEN [34.5, 37.5] WHEN 'knee' THEN [37.5, 41.5]
  WHEN 'midi' THEN [41.5, 45.5] WHEN 'mid_calf' THEN [45.5, 51] WHEN 'maxi' THEN [51, 57.5] WHEN 'floor' THEN [57.5, 70] END"""


@query("clamped_estimates", sql(f"""SELECT listing_id, CASE WHEN ok THEN raw END AS inches, NOT ok AS clamped FROM (SELECT *, raw BETWEEN 18 AND 70 AND
  (band IS NULL OR raw BETWEEN band[1] - 2 AND band[2] + 2) AS ok FROM (SELECT listing_id, 10.0::DOUBLE + k % 70 AS raw, {BANDS} AS band FROM e))""", "attrs", e=EST))
def _(spark, d):
    raw = F.lit(10.0) + F.substring("listing_id", 2, 20).cast("long") % 70
    return T.extractions(spark, d).select("listing_id", lengths.clamp_estimate(raw, F.col("length_class")).alias("c")).select("listing_id", "c.*")


@query("estimates_applied", sql("""SELECT listing_id, CASE WHEN k % 4 = 0 THEN 44.0 WHEN k % 4 IN (1, 2) THEN NULL ELSE length_inches END AS length_inches,
  CASE WHEN k % 4 = 0 THEN 'image_estimate' WHEN k % 4 IN (1, 2) THEN 'not_estimable' ELSE length_basis END AS length_basis FROM e""", "attrs", e=EST))
def _(spark, d):
    have = estimated(spark, d)
    out = have.select("content_hash", F.expr("element_at(array('estimated', 'clamped', 'no_estimate', 'failed'), cast(cast(substring(listing_id, 2) as bigint) % 4 + 1 as int))")
                      .alias("status"), F.lit(44.0).alias("inches"), F.lit("assumed_default").alias("anchor"), F.lit(69.0).alias("anchor_height"))
    return lengths.apply_estimates(have, out).select("listing_id", "length_inches", "length_basis")


@query("reanchor_scan", sql("""SELECT count(*) AS scanned, count(*) FILTER (k % 7 < 5) AS with_height, count(*) FILTER (k % 7 IN (0, 2, 3, 4)) AS targets
FROM e WHERE length_basis = 'image_estimate' AND length_inches IS NOT NULL AND model <> 'manual' AND k % 3 <> 1""", "attrs", e=EST))
def _(spark, d):
    k = "cast(substring(listing_id, 2) as bigint)"
    told = estimated(spark, d).withColumns({"title": F.lit("dress"), "description": F.expr(
        f"if({k} % 7 < 5, concat('Our model is 5''', 8 + {k} % 7, '\" tall and wears a size S. Length: 60 in'), 'no model')")})
    return lengths.reanchor_scan(told)[1]


@query("scaled_landmarks", sql("""SELECT user_id, floor(56.5 * height_inches / 69 * 10 + 0.5) / 10 AS shoulder, floor(19.5 * height_inches / 69 * 10 + 0.5) / 10 AS knee,
  floor(11 * height_inches / 69 * 10 + 0.5) / 10 AS mid_calf, floor(3 * height_inches / 69 * 10 + 0.5) / 10 AS ankle FROM users""".replace("56.5", "56.5::DOUBLE").replace("19.5", "19.5::DOUBLE"), "users"))
def _(spark, d):
    return T.users(spark, d).select("user_id", lengths.landmarks(F.col("height_inches")).alias("l")).select("user_id", "l.*")


# --- profiles --------------------------------------------------------------------------------------------------
@query("profiles_patched", sql("""SELECT c_custkey AS user_id, CASE WHEN p.h THEN p.height ELSE CASE WHEN c_custkey % 19 <> 0 THEN 60.0 + c_custkey % 13 END END AS height_inches,
  CASE WHEN p.l THEN p.heel ELSE (c_custkey % 4)::DOUBLE END AS heel_inches FROM customer LEFT JOIN (SELECT o_custkey, bool_or(o_orderkey % 3 = 0) AS h, bool_or(o_orderkey % 3 = 1) AS l,
    arg_max(CASE WHEN o_orderkey % 6 = 0 THEN -1 ELSE 50.0 + o_orderkey % 30 END, o_orderkey) FILTER (o_orderkey % 3 = 0) AS height0,
    nullif(arg_max(CASE WHEN o_orderkey % 6 = 0 THEN -1 ELSE 50.0 + o_orderkey % 30 END, o_orderkey) FILTER (o_orderkey % 3 = 0), -1) AS height,
    arg_max((o_orderkey % 5)::DOUBLE, o_orderkey) FILTER (o_orderkey % 3 = 1) AS heel FROM orders GROUP BY o_custkey) p ON o_custkey = c_custkey"""))
def _(spark, d):
    patches = T.read(spark, d, "orders").selectExpr(
        "o_custkey as user_id", "o_orderkey as seq", "case o_orderkey % 3 when 0 then array('height_inches') when 1 then array('heel_inches') else cast(array() as array<string>) end as names",
        "if(o_orderkey % 6 = 0, null, cast(50 + o_orderkey % 30 as double)) as height_inches", "cast(o_orderkey % 5 as double) as heel_inches")
    return profiles.patched_profiles(T.users(spark, d), patches, ["height_inches", "heel_inches"]).select("user_id", "height_inches", "heel_inches")


@query("brand_sizes", sql("""SELECT c_custkey AS user_id, coalesce(string_agg(b || '=' || s, ',' ORDER BY b, s), '') AS sizes FROM customer LEFT JOIN (SELECT o_custkey, 'b' || (l_linenumber % 3) AS b,
  arg_max(q, l_linenumber) AS s FROM (SELECT l_orderkey, l_linenumber, max('s' || l_quantity::BIGINT) AS q FROM lineitem GROUP BY ALL) JOIN (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY o_custkey) ON k = l_orderkey
  GROUP BY ALL) ON o_custkey = c_custkey GROUP BY c_custkey"""))
def _(spark, d):
    orders = T.read(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("seq"))
    lines = T.read(spark, d, "lineitem").selectExpr(
        "l_orderkey as seq", "l_linenumber as ord", "concat('b', l_linenumber % 3) as brand", "concat('s', cast(l_quantity as bigint)) as size_label")
    puts = orders.join(lines.groupBy("seq", "ord").agg(F.max("brand").alias("brand"), F.max("size_label").alias("size_label")), "seq", "left")
    none = spark.createDataFrame([], "user_id bigint, brand string, size_label string")
    out = profiles.with_brand_sizes(T.users(spark, d), profiles.replaced_brand_sizes(none, puts))
    return out.select("user_id", F.array_join(F.transform("brand_sizes", lambda b: F.concat(b["brand"], F.lit("="), b["size_label"])), ",").alias("sizes"))


@query("extraction_with_hints", sql("""SELECT listing_id, coalesce(CASE WHEN k % 3 = 0 THEN 'micro' END, length_class) AS length_class, coalesce(CASE WHEN k % 4 = 0 THEN 'tweed' END, fabric) AS fabric,
  coalesce(CASE WHEN k % 5 = 0 THEN 'plaid' END, pattern, CASE WHEN k % 6 = 0 THEN 'solid' END) AS pattern, CASE WHEN k % 7 = 0 THEN 'brunch,work' ELSE occasions END AS occasions, CASE WHEN k % 6 = 0 THEN 'teal' ELSE colors END AS colors
FROM plain JOIN (SELECT listing_id, listing_key AS k FROM listings) USING (listing_id)""", "listings", "attrs",
                                     plain="SELECT listing_id, length_class, fabric, pattern, coalesce(occasion, '') AS occasions, array_to_string(families, ',') AS colors FROM attrs"))
def _(spark, d):
    """Hints of the source for some fields of some listings; what they leave open comes from the text."""
    k = "listing_key"
    hinted = T.listings(spark, d).withColumn("hints", F.expr(
        f"named_struct('length_class', if({k} % 3 = 0, 'micro', null), 'fabric', if({k} % 4 = 0, 'tweed', null), 'pattern', if({k} % 5 = 0, 'plaid', null), "
        f"'occasions', if({k} % 7 = 0, array('brunch', 'work'), cast(array() as array<string>)), 'colors', if({k} % 6 = 0, array(named_struct('name', 'sea', 'family', 'teal')), null))"))
    rows = X.extract(hinted)
    return rows.select("listing_id", "length_class", "fabric", "pattern", F.array_join("occasions", ",").alias("occasions"), F.array_join(F.transform("colors", lambda c: c["family"]), ",").alias("colors"))


@query("payloads_coerced", sql("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'above_knee' WHEN 1 THEN 'mini' END AS length_class, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS DOUBLE) END AS length_inches,
  CASE p_partkey % 4 WHEN 0 THEN 'a_line' WHEN 3 THEN NULL ELSE 'other' END AS silhouette, CASE WHEN p_partkey % 2 = 0 THEN 'red' ELSE '' END AS colors,
  CASE WHEN p_partkey % 6 = 0 THEN 'work,party' ELSE '' END AS occasions, CASE WHEN p_partkey % 3 = 1 THEN 33.5 END AS bust, CASE WHEN p_partkey % 3 = 2 THEN 0.25 ELSE 0.5 END AS confidence FROM part WHERE p_partkey % 10 <> 9
  UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM part WHERE p_partkey % 10 = 9"""))
def _(spark, d):
    """Payloads with words outside the vocabularies, numbers in quotes, items of the wrong shape, and some that are no object at all."""
    k = "p_partkey"
    body = f"""concat('{{"lengthClass":', {T.pick(['"Above Knee"', '" MINI "', '"ankle-ish"', '7', 'null'], f'{k} % 5')}, ',"lengthInches":', if({k} % 3 = 0, cast(p_size as string), concat('"', p_size, '"')),
      ',"silhouette":', {T.pick(['"A-Line"', '"mermaid"', '["wrap"]', 'null'], f'{k} % 4')}, ',"colors":', if({k} % 2 = 0, '[{{"name":"Ruby","family":"red"}},{{"name":"x"}},"blue",null]', '"red"'),
      ',"occasions":', if({k} % 6 = 0, '["work",3,"Party","party","gala"]', '{{}}'), ',"measurements":', {T.pick(['null', '{"bust":33.5,"waist":"27"}', '[1]'], f'{k} % 3')}, if({k} % 3 = 2, ',"confidence":0.25', ',"confidence":"high"'), '}}')"""
    rows = spread(T.read(spark, d, "part"), k).select(k, coerced(F.expr(f"if({k} % 10 = 9, if({k} % 20 = 9, '[1, 2]', 'no json'), {body})")).alias("c"))
    return rows.select(k, "c.length_class", "c.length_inches", "c.silhouette", F.array_join(F.transform("c.colors", lambda c: c["family"]), ",").alias("colors"),
                       F.array_join("c.occasions", ",").alias("occasions"), "c.measurements.bust", "c.confidence")


def toggles(spark, d):
    return T.read(spark, d, "events").selectExpr(
        "event_id as toggle_id", "user_id", f"if(event_id % 11 = 0, null, {T.event_listing(spark, d)}) as listing_id",
        "if(event_type = 'view', 'price_drop', 'low_stock') as kind", "event_id % 3 <> 0 as enabled", "if(event_id % 4 = 0, concat('q', event_id), null) as search",
        "unix_millis(cast(ts as timestamp)) as created_ms")


TOGGLES = f"""SELECT event_id AS toggle_id, user_id, CASE WHEN event_id % 11 <> 0 THEN {EVENT_LISTING} END AS listing_id,
  CASE WHEN event_type = 'view' THEN 'price_drop' ELSE 'low_stock' END AS kind, event_id % 3 <> 0 AS enabled, CASE WHEN event_id % 4 = 0 THEN 'q' || event_id END AS search,
  epoch_us(ts) // 1000 AS created_ms FROM events"""
ALERTS = """SELECT user_id, listing_id, kind, arg_max(enabled, ord) AS enabled, arg_max(search, ord) FILTER (search IS NOT NULL) AS search, min(created_ms) AS created_ms,
  max(created_ms) AS updated_ms FROM (SELECT *, CAST(created_ms AS HUGEINT) * 1000000000 + toggle_id AS ord, CASE WHEN listing_id IS NULL THEN toggle_id END AS own FROM t)
  GROUP BY user_id, listing_id, kind, own"""


@query("alert_state", sql("SELECT * FROM a", t=TOGGLES, a=ALERTS))
def _(spark, d):
    return profiles.alert_state(toggles(spark, d))


@query("latest_alerts", sql("""SELECT user_id, kind, listing_id, enabled, updated_ms FROM (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY updated_ms DESC,
  created_ms DESC, coalesce(listing_id, '') DESC) AS rn FROM a) WHERE rn = 1""", t=TOGGLES, a=ALERTS))
def _(spark, d):
    return profiles.latest_alert(profiles.alert_state(toggles(spark, d)))


# --- clean-ups -------------------------------------------------------------------------------------------------
def stores(spark, d):
    """Stores of the shopify and jsonld sources; even nations sell one brand."""
    return T.read(spark, d, "nation").filter("n_nationkey % 4 in (0, 2)").selectExpr(
        f"{T.source_of('n_nationkey')} as source_id", "n_name as display_name", "if(n_nationkey % 8 = 0, concat('House ', n_nationkey), null) as brand_name",
        "if(n_nationkey % 4 = 0, 'single', 'multi') as brand_mode", "array('Brand#12', 'Brand#1') as known_brands")


VENDOR = """CASE listing_key % 6 WHEN 0 THEN 'SP26B' WHEN 1 THEN brand || ' HOLIDAY SALE' WHEN 2 THEN 'OSHADI (OPC) PRIVATE LIMITED' WHEN 3 THEN 'FALL 2023'
  WHEN 4 THEN brand ELSE 'Free Folk' END"""
REBRAND = f"""SELECT source_id, vendor AS before, CASE WHEN nation % 4 NOT IN (0, 2) THEN vendor WHEN regexp_matches(vendor, '(^|\\W)Brand#12(\\W|$)', 'i') THEN 'Brand#12'
  WHEN regexp_matches(vendor, '(^|\\W)Brand#1(\\W|$)', 'i') THEN 'Brand#1' WHEN nation % 4 = 0 THEN own
  WHEN coalesce(vendor, '') = '' OR k IN (0, 2, 3) OR (k = 1 AND vendor IS NOT NULL) THEN own ELSE vendor END AS after
FROM (SELECT *, {VENDOR} AS vendor, listing_key % 6 AS k, CASE WHEN nation % 8 = 0 THEN 'House ' || nation ELSE 'NATION_' || nation END AS own FROM listings)"""


def vendors(spark, d):
    return T.listings(spark, d).withColumn("brand", F.expr(VENDOR))


@query("brand_report", sql("SELECT source_id, before, after, count(*) AS n FROM r WHERE before IS DISTINCT FROM after GROUP BY ALL", "listings", r=REBRAND))
def _(spark, d):
    return cleanup.brand_report(vendors(spark, d), stores(spark, d))


@query("brands_applied", sql("SELECT source_id, coalesce(after, '-') AS brand, count(*) AS n FROM r GROUP BY ALL", "listings", r=REBRAND))
def _(spark, d):
    return cleanup.apply_brands(vendors(spark, d), stores(spark, d)).groupBy("source_id", F.coalesce("brand", F.lit("-")).alias("brand")).agg(F.count(F.lit(1)).alias("n"))


@query("vendor_codes", sql(f"SELECT DISTINCT vendor, coalesce(vendor, '') = '' OR k IN (0, 2, 3) OR k = 1 AS code FROM (SELECT {VENDOR} AS vendor, listing_key % 6 AS k FROM listings)",
                           "listings"))
def _(spark, d):
    return vendors(spark, d).select(F.col("brand").alias("vendor"), B.is_vendor_code(F.col("brand")).alias("code")).distinct()


@query("cache_orphans", sql("SELECT count(*) AS orphans FROM vectors WHERE content_hash NOT IN (SELECT content_hash FROM listings)", "vectors", "listings"))
def _(spark, d):
    l = T.listings(spark, d)
    return cleanup.orphans(T.embeddings(spark, d, l), l)


@query("child_flags", sql("SELECT listing_id, 'keyword:girls' AS reason FROM listings WHERE listing_key % 29 = 0 AND removed_ms IS NULL", "listings"))
def _(spark, d):
    return cleanup.flagged_children(T.listings(spark, d)).select("listing_id", "reason")


def judged(spark, d):
    """Extractions in which some flagged listings carry an adult verdict."""
    return T.extractions(spark, d).withColumn("audience", F.expr("if(cast(substring(listing_id, 2) as bigint) % 58 = 0, 'adult', null)"))


@query("child_flags_cleared", sql("SELECT listing_id, listing_key % 58 = 0 AS cleared FROM listings WHERE listing_key % 29 = 0 AND removed_ms IS NULL", "listings"))
def _(spark, d):
    kept, cleared = cleanup.kept_flags(cleanup.flagged_children(T.listings(spark, d)), judged(spark, d))
    return kept.select("listing_id", F.lit(False).alias("cleared")).unionByName(cleared.select("listing_id", F.lit(True).alias("cleared")))


@query("child_flag_report", sql("""SELECT source_id, count(*) AS n, array_to_string(list_slice(list(title || ' [keyword:girls]' ORDER BY listing_id), 1, 5), '; ') AS samples
FROM listings WHERE listing_key % 29 = 0 AND removed_ms IS NULL GROUP BY source_id""", "listings"))
def _(spark, d):
    return cleanup.flag_report(cleanup.flagged_children(T.listings(spark, d))).select("source_id", "n", F.array_join("samples", "; ").alias("samples"))


@query("purge_applied", sql(f"""SELECT count(*) FILTER (removed_ms IS NULL AND NOT hit) AS active, count(*) FILTER (hit AND removed_ms IS NULL) AS purged FROM
  (SELECT *, listing_key % 29 = 0 AND listing_key % 58 <> 0 AS hit FROM listings)""", "listings"))
def _(spark, d):
    l, e = T.listings(spark, d), judged(spark, d)
    kept, _ = cleanup.kept_flags(cleanup.flagged_children(l), e)
    gone, _ = cleanup.apply_purge(l, e, kept, NOW + 1)
    return gone.agg(F.count_if(F.col("removed_ms").isNull()).alias("active"), F.count_if(F.col("removed_ms") == NOW + 1).alias("purged"))


@query("vision_suspects", sql("""SELECT listing_id, image_urls[1] AS image_url FROM listings WHERE source_id IN ('shopify:n0', 'shopify:n4', 'jsonld:n2') AND removed_ms IS NULL
  AND listing_key % 58 <> 0 AND listing_key % 29 <> 0""", "listings"))
def _(spark, d):
    l = T.listings(spark, d)
    pool = T.sources(spark, d).filter(F.col("source_id").isin("shopify:n0", "shopify:n4", "jsonld:n2")).select("source_id")
    return cleanup.vision_suspects(l, judged(spark, d), T.listing_images(spark, d), pool).select("listing_id", "image_url")


@query("kid_sizes", sql("SELECT p_partkey, p_size BETWEEN 1 AND 15 AS pair, true AS years, false AS adult FROM part"))
def _(spark, d):
    s = F.col("p_size")
    pair = F.concat(s.cast("string"), F.lit(" / "), (s + 1).cast("string"))
    return T.read(spark, d, "part").select(
        "p_partkey", F.coalesce(AU.is_kid_size(pair), F.lit(False)).alias("pair"),
        AU.is_kid_size(F.concat(s.cast("string"), F.lit(" yrs"))).alias("years"), AU.is_kid_size(F.concat(F.lit("US "), s.cast("string"))).alias("adult"))


@query("reconcile_counts", sql("""SELECT t AS "table", live, restored, ok FROM (SELECT 'customer' AS t, (SELECT count(*) FROM customer) AS live, (SELECT count(*) FROM customer WHERE c_custkey % 100 <> 0) AS restored, true AS ok
UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), (SELECT count(*) FROM orders WHERE o_orderkey % 10 <> 0), false UNION ALL SELECT 'part', (SELECT count(*) FROM part), -1, false)"""))
def _(spark, d):
    c, o, p = (T.read(spark, d, t) for t in ("customer", "orders", "part"))
    live = reconcile.count_table({"customer": c, "orders": o, "part": p})
    restored = reconcile.count_table({"customer": c.filter("c_custkey % 100 <> 0"), "orders": o.filter("o_orderkey % 10 <> 0")})
    return reconcile.reconcile(live, restored)


# --- errors ----------------------------------------------------------------------------------------------------
GROUPS = """SELECT stack_hash, any_value(route) AS route, arg_max(message, CAST(ts_ms AS HUGEINT) * 1000000000 + error_id) AS message, count(*) AS count, min(ts_ms) AS first_seen_ms,
  max(ts_ms) AS last_seen_ms, max(ts_ms // 3600000) AS hour_bucket FROM errors GROUP BY stack_hash"""
HOURS = "SELECT g.*, (SELECT count(*) FROM errors e WHERE e.stack_hash = g.stack_hash AND e.ts_ms // 3600000 = g.hour_bucket) AS hour_count FROM g"


@query("error_groups", sql("SELECT * FROM h", "errors", g=GROUPS, h=HOURS))
def _(spark, d):
    return errors.error_groups(T.error_events(spark, d)).drop("stack")


@query("error_stats", sql(f"""SELECT count(*) AS groups, CAST(coalesce(sum(hour_count) FILTER (hour_bucket >= {T.EVENTS_NOW_MS} // {HOUR} - 1), 0) AS BIGINT) AS last_hour,
  coalesce(sum(hour_count) FILTER (hour_bucket >= {T.EVENTS_NOW_MS} // {HOUR} - 1), 0) >= 20 AS spike FROM h""", "errors", g=GROUPS, h=HOURS))
def _(spark, d):
    return errors.error_stats(errors.error_groups(T.error_events(spark, d)), T.EVENTS_NOW_MS)


@query("error_retention", sql(f"SELECT stack_hash FROM g WHERE last_seen_ms >= {T.EVENTS_NOW_MS - 30 * DAY} ORDER BY last_seen_ms DESC, stack_hash LIMIT 20", "errors", g=GROUPS))
def _(spark, d):
    return errors.retained(errors.error_groups(T.error_events(spark, d)), T.EVENTS_NOW_MS, max_groups=20).select("stack_hash")


@query("recent_error_groups", sql("SELECT stack_hash, last_seen_ms FROM g ORDER BY last_seen_ms DESC, stack_hash LIMIT 10", "errors", g=GROUPS))
def _(spark, d):
    return errors.recent_groups(errors.error_groups(T.error_events(spark, d)), 10).select("stack_hash", "last_seen_ms")


@query("error_spikes", sql(f"""SELECT s * {HOUR} AS start_ms, (s + 2) * {HOUR} AS end_ms, count(*) AS n FROM (SELECT unnest([ts_ms // {HOUR}, ts_ms // {HOUR} - 1]) AS s FROM errors)
  GROUP BY s HAVING count(*) >= 5""", "errors"))
def _(spark, d):
    return errors.hourly_spikes(T.error_events(spark, d), 5)
