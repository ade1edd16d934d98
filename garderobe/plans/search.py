"""Hybrid search for a table of queries: interpret, pool, gate on evidence, blend, rank, spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garderobe.functions import scoring as S
from garderobe.functions.interpret import interpret, merge_parse, wanted_tags
from garderobe.functions.vectors import as_double, norm
from garderobe.operators.cells import profile_candidates
from garderobe.operators.diversity import interleave
from garderobe.operators.filters import active
from garderobe.plans import feed
from garderobe.session import stage
from garderobe.values import CANDIDATE_CAP, SEMANTIC_TOP_K

QUERIES_A_LOT = 500  # each with a pool of up to the cap
BESIDE = ["_profile", "_lot"]
OF_SIDES = ["_tags", "_n_tags", "_again", "_words", "_n_words", "_has", "_said", "_q", "_q_norm", "_v", "_v_norm"]


def plan_queries(queries: DataFrame, catalog: DataFrame, other_parse: DataFrame | None = None,
                 explicit: DataFrame | None = None) -> DataFrame:
    """Interpreted queries; ``explicit`` (query_id, price_min_cents, price_max_cents, sizes, length_classes, brands) holds filters
    the searcher set by hand, which replace the derived ones field by field."""
    brands = catalog.filter(active() & F.col("brand").isNotNull()).select("brand")
    parsed = interpret(queries, brands)
    parsed = merge_parse(parsed, other_parse, brands) if other_parse is not None else parsed.withColumn(
        "vibe_text", F.lit(None).cast("string"))
    if explicit is not None:
        names = ["price_min_cents", "price_max_cents", "sizes", "length_classes", "brands"]
        e = explicit.select("query_id", *[F.col(c).alias(f"_e_{c}") for c in names])
        parsed = parsed.join(e, "query_id", "left")
        by_hand = F.col("_e_price_min_cents").isNotNull() | F.col("_e_price_max_cents").isNotNull()
        out = {c: F.when(by_hand, F.col(f"_e_{c}")).otherwise(F.col(c)) for c in names[:2]}
        out |= {c: F.when(F.size(f"_e_{c}") > 0, F.col(f"_e_{c}")).otherwise(F.col(c)) for c in names[2:]}
        parsed = parsed.withColumns(out).drop(*[f"_e_{c}" for c in names])
    return parsed.withColumn("tags", wanted_tags(parsed))


def query_pools(plans: DataFrame, live: DataFrame, cap: int = CANDIDATE_CAP, asked: DataFrame | None = None, shown: DataFrame | None = None) -> DataFrame:
    """Source-fair candidate pool per query; equal filters are pooled once.

    ``asked`` (query_id, ...) and ``shown`` (listing_id, ...) are joined to queries and pool rows before these meet, see ``_met``.
    """
    key = F.sha2(F.to_json(F.struct("price_min_cents", "price_max_cents", F.array_sort("sizes").alias("s"),
                                    F.array_sort("brands").alias("b"), F.array_sort("length_classes").alias("l"))), 256)
    keyed = plans.withColumn("profile_id", key)
    profiles = keyed.select(
        "profile_id", "sizes", F.col("price_min_cents").alias("low"), F.col("price_max_cents").alias("high"),
        F.transform("brands", lambda b: F.lower(b)).alias("f_brand"), F.col("length_classes").alias("f_length"),
    ).dropDuplicates(["profile_id"])
    pools = profile_candidates(profiles, live, cap, {"f_brand": F.lower("brand"), "f_length": F.col("length_class")})
    if asked is not None:
        return _met(keyed.select("query_id", "profile_id"), pools.select("profile_id", "listing_id"), asked, shown)
    return keyed.select("query_id", "profile_id").join(pools.select("profile_id", "listing_id"), "profile_id").drop("profile_id")


def unique(df: DataFrame, key: str) -> bool:
    return df.groupBy(key).count().filter("count > 1").isEmpty()


def _met(keyed: DataFrame, pools: DataFrame, asked: DataFrame, shown: DataFrame) -> DataFrame:
    """Rows of ``asked`` with those of ``shown`` in their profile's pool; pairs are made where they stay, and not shuffled.

    A profile's queries are dealt to lots, and its pool rows are sent to each lot, by ``BESIDE``, the columns by which pairs lie from then
    on. They are left out where a query id has several rows, whose pairs must be gathered by the id.
    """
    spark = keyed.sparkSession
    lots = F.ceil(F.count(F.lit(1)) / QUERIES_A_LOT).cast("int")
    profiles = stage(keyed.groupBy("profile_id").agg(lots.alias("_lots")).withColumn("_profile", F.monotonically_increasing_id()), "search-profiles")
    tasks = max(keyed.count() // QUERIES_A_LOT, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = keyed.join(profiles, "profile_id").select("query_id", "_profile", F.pmod(F.xxhash64("query_id"), "_lots").cast("int").alias("_lot"))
    sent = pools.join(profiles, "profile_id").select("listing_id", "_profile", F.explode(F.sequence(F.lit(0), F.col("_lots") - 1)).alias("_lot"))
    left, right = own.join(asked, "query_id").repartition(tasks, *BESIDE), sent.join(shown, "listing_id").repartition(tasks, *BESIDE)
    pairs = left.join(right, BESIDE)
    return pairs if unique(keyed, "query_id") else pairs.drop(*BESIDE)


def said_tokens(texts: DataFrame, tokens: DataFrame, text: Column) -> DataFrame:
    """(listing_id, said): the tokens (token, without white space) that occur anywhere in a listing's text, in words or parts of words.

    Tokens meet the catalog's distinct words by their first three letters, and every word is compared once however many listings say
    it, so no text travels with the pairs of a search. Listings that say none have no row.
    """
    spoken = texts.select("listing_id", F.explode(F.array_distinct(F.split(F.lower(text), r"\s+"))).alias("word")).filter("word <> ''")
    starts = "transform(sequence(1, length(word)), i -> substring(word, i, {n}))"
    grams = F.array_distinct(F.concat(*[F.expr(starts.format(n=n)) for n in (1, 2, 3)]))
    asked = tokens.select(F.lower("token").alias("token")).distinct().filter("token <> ''").withColumn("gram", F.substring("token", 1, 3))
    inside = spoken.select("word").distinct().withColumn("gram", F.explode(grams)).join(asked, "gram").filter(
        F.contains(F.col("word"), F.col("token"))).select("word", "token")
    return spoken.join(inside, "word").groupBy("listing_id").agg(F.collect_set("token").alias("said"))


def _hashes(values: Column) -> Column:
    """Hashes of the texts of a list, for lists that meet in many pairs."""
    return F.transform(F.filter(values, lambda v: v.isNotNull()), lambda v: F.xxhash64(v))


def _vector(column: str, name: str) -> list[Column]:
    return [as_double(F.col(column)).alias(name), norm(F.col(column)).alias(f"{name}_norm")]


def query_side(plans: DataFrame, query_vectors: DataFrame | None = None) -> DataFrame:
    """What relevance needs of a query: its tags, words and vector."""
    asked = plans.select("query_id", _hashes(F.col("tags")).alias("_tags"), F.size("tags").alias("_n_tags"), (F.size(F.array_distinct("tags")) < F.size("tags")).alias("_again"),
                         F.array_distinct(_hashes(F.col("residual"))).alias("_words"), F.size("residual").alias("_n_words"))
    return asked if query_vectors is None else asked.join(query_vectors.select("query_id", *_vector("vector", "_q")), "query_id", "left")


def listing_side(plans: DataFrame, catalog: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """What relevance needs of a listing: its tags, the words of all queries that it says, its vector."""
    text = F.concat_ws(" ", "title", F.coalesce("brand", F.lit("")), F.coalesce("description", F.lit("")))
    said = said_tokens(catalog, plans.select(F.explode("residual").alias("token")), text)
    tags = F.map_keys(F.map_filter("attribute_vector", lambda _, weight: weight > 0))
    shown = catalog.select("listing_id", _hashes(tags).alias("_has")).join(said.select("listing_id", _hashes(F.col("said")).alias("_said")), "listing_id", "left")
    return shown if vectors is None else shown.join(vectors.select("listing_id", *_vector("vector", "_v")), "listing_id", "left")


def evidence(pools: DataFrame) -> DataFrame:
    """Pool rows that hold both sides, with their parts of the relevance (attr, lex, _raw) in place of the sides.

    Rows without any part leave where the query has a signal: they are no evidence, and give the others no other place.
    """
    semantic = "_q" in pools.columns and "_v" in pools.columns
    hits = F.when(F.col("_again"), F.size(F.filter("_tags", lambda t: F.coalesce(F.array_contains("_has", t), F.lit(False))))).otherwise(F.size(F.array_intersect("_tags", "_has")))
    signal, raw = (F.col("_n_tags") > 0) | (F.col("_n_words") > 0), F.lit(None).cast("double")
    if semantic:
        both = F.col("_q").isNotNull() & F.col("_v").isNotNull()
        scale = F.col("_q_norm") * F.col("_v_norm")
        product = F.aggregate(F.zip_with("_q", "_v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        cosine = F.when(scale > 0, product / scale).otherwise(0.0)  # not in Python: what comes from there has to be shuffled again to be ranked
        signal, raw = signal | F.col("_q").isNotNull(), F.when(both, F.round((cosine + 1) / 2, 9))
    rows = pools.withColumns({
        "attr": S.fraction(hits, F.col("_n_tags")), "lex": S.fraction(F.size(F.array_intersect("_words", "_said")), F.col("_n_words")),
        "_raw": raw, "_signal": signal,
    }).drop(*OF_SIDES)
    return rows.filter(~F.col("_signal") | (F.coalesce("attr", F.lit(0.0)) > 0) | (F.coalesce("lex", F.lit(0.0)) > 0) | F.col("_raw").isNotNull())


def judged(rows: DataFrame, top_k: int = SEMANTIC_TOP_K) -> DataFrame:
    """``relevance`` of rows with ``evidence``, in place of its parts; other columns stay."""
    nearest = Window.partitionBy(*[c for c in BESIDE if c in rows.columns], "query_id").orderBy(F.desc_nulls_last("_raw"), "listing_id")
    whole = nearest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    span = F.max("_raw").over(whole) - F.min("_raw").over(whole)
    rows = rows.withColumns({
        "sem": F.when(F.col("_raw").isNotNull(), F.when(span == 0, 0.5).otherwise((F.col("_raw") - F.min("_raw").over(whole)) / span)),
        "_near": F.col("_raw").isNotNull() & (F.row_number().over(nearest) <= top_k),
    })
    found = (F.coalesce("attr", F.lit(0.0)) > 0) | (F.coalesce("lex", F.lit(0.0)) > 0) | F.col("_near")
    score = F.coalesce(S.relevance(F.col("attr"), F.col("sem"), F.col("lex")), F.lit(0.0))
    return rows.filter(~F.col("_signal") | found).withColumn("relevance", F.when(F.col("_signal"), score)).drop("attr", "lex", "sem", "_raw", "_near", "_signal")


def relevance(plans: DataFrame, pools: DataFrame, catalog: DataFrame, query_vectors: DataFrame | None = None,
              vectors: DataFrame | None = None, top_k: int = SEMANTIC_TOP_K) -> DataFrame:
    """(query_id, listing_id, relevance) of pool rows with evidence: a matching tag, a matching word, or a place among the
    ``top_k`` closest vectors. Queries without any signal keep their whole pool with NULL relevance.

    ``pools`` whose rows hold both sides already are judged where they lie.
    """
    if "_tags" not in pools.columns:
        sides = (query_vectors, vectors) if query_vectors is not None and vectors is not None else (None, None)
        pools = pools.select("query_id", "listing_id").join(listing_side(plans, catalog, sides[1]), "listing_id").join(query_side(plans, sides[0]), "query_id")
    return judged(evidence(pools), top_k).select("query_id", "listing_id", "relevance")


def batch_search(queries: DataFrame, users: DataFrame, catalog: DataFrame, sources: DataFrame, now_ms: int,
                 other_parse: DataFrame | None = None, explicit: DataFrame | None = None,
                 query_vectors: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """(query_id, position, listing_id, score, relevance) for queries (query_id, user_id, text)."""
    live = feed.live_catalog(catalog, sources, now_ms)
    plans = stage(plan_queries(queries, catalog, other_parse, explicit), "search-plans")
    searchers = queries.select("query_id", "user_id").join(users, "user_id").withColumns({
        "user_id": F.col("query_id"), "profile_id": F.col("query_id"),
        "length_prefs": F.array().cast("array<string>"),
    }).drop("query_id")
    ids = [(plans, "query_id"), (searchers, "user_id"), (live, "listing_id"), *([] if vectors is None else [(vectors, "listing_id")]), *([] if query_vectors is None else [(query_vectors, "query_id")])]
    if all(unique(df, key) for df, key in ids):  # a pair is one row throughout: it is judged, scored and placed where it is made
        both = (query_vectors, vectors) if query_vectors is not None and vectors is not None else (None, None)
        asked = query_side(plans, both[0]).join(feed.user_side(searchers).drop("profile_id").withColumnRenamed("user_id", "query_id"), "query_id")
        shown = listing_side(plans, live, both[1]).join(feed.listing_side(live, now_ms), "listing_id")
        pairs = evidence(query_pools(plans, live, asked=asked, shown=shown)).withColumnRenamed("query_id", "user_id")
        scored = feed.scored(pairs, keep=["attr", "lex", "_raw", "_signal", *BESIDE]).withColumnRenamed("user_id", "query_id")  # no query has a hem preference: all its rows stay
        rows, beside = judged(scored).withColumnRenamed("query_id", "user_id"), BESIDE
    else:  # rows of equal ids multiply in the joins
        found = stage(relevance(plans, query_pools(plans, live), live, query_vectors, vectors), "search-found")  # read twice below
        pairs = feed.scored_pairs(searchers, live, found.select(F.col("query_id").alias("profile_id"), "listing_id"), now_ms)
        rows, beside = pairs.join(found.withColumnRenamed("query_id", "user_id"), ["user_id", "listing_id"]), []
    rows = rows.withColumn("score", F.when(F.col("relevance").isNull(), F.col("score")).otherwise(
        F.round(S.blend_search(F.col("relevance"), F.col("score")), feed.SCORE_DIGITS)))
    return interleave(feed.ranked(rows, beside), "user_id", beside=beside).withColumnRenamed("user_id", "query_id")
