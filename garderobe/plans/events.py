"""Event summary over rolling windows: counts, funnel, searches, filters and swipe mix.

Windows are nested (24 h inside 7 d), so each event is tagged once with the smallest window that holds it (its ring).
Aggregates run per ring and are widened afterwards, on aggregated rows only: events are never multiplied by windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garderobe.functions.money import share
from garderobe.operators.quantiles import exact_median
from garderobe.session import stage

DAY_MS = 86_400_000
WINDOWS = (("24h", DAY_MS), ("7d", 7 * DAY_MS))
TOP_SEARCHES = 20


def actor() -> Column:
    return F.coalesce("user_id", "anon_id")


PROPS = ("step", "durationMs", "query", "resultCount", "kind", "verdict")


def prop(name: str) -> Column:
    return F.col(f"_{name}")


def parsed(events: DataFrame) -> DataFrame:
    """Events with their props as columns; JSON is read once for all of them."""
    if f"_{PROPS[0]}" in events.columns:
        return events
    read = F.from_json("props", ", ".join(f"{name} string" for name in PROPS)).alias("_p")
    return events.withColumn("_p", read).select("*", *[F.col(f"_p.{name}").alias(f"_{name}") for name in PROPS]).drop("_p", "props")


def ringed(events: DataFrame, now_ms: int, windows=WINDOWS) -> DataFrame:
    """Events inside the widest window, with ``ring`` = index of the smallest window holding each."""
    ring = None
    for i, (_, span) in enumerate(windows):
        inside = F.col("created_ms") >= now_ms - span
        ring = F.when(inside, i) if ring is None else ring.when(inside, i)
    widest = now_ms - windows[-1][1]
    return events.filter(F.col("created_ms") >= widest).withColumn("ring", ring)


def widen(df: DataFrame, windows=WINDOWS) -> DataFrame:
    """One row per window that holds the row's ring."""
    names = F.array(*[F.lit(name) for name, _ in windows])
    return df.withColumn("win", F.explode(F.slice(names, F.col("ring") + 1, len(windows)))).drop("ring")


def event_counts(events: DataFrame, now_ms: int, windows=WINDOWS) -> DataFrame:
    per_ring = ringed(events, now_ms, windows).groupBy("ring", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return widen(per_ring, windows).groupBy("win", "event_type").agg(F.sum("n").alias("n"))


def distinct_actors(events: DataFrame, now_ms: int, windows=WINDOWS, by: Column | None = None) -> DataFrame:
    """Distinct actors per window and event type (and ``by``): first one row per actor, then counts."""
    keys = {"event_type": F.col("event_type"), "actor": actor()}
    if by is not None:
        keys["by"] = by
    per_actor = ringed(events, now_ms, windows).groupBy(*[c.alias(n) for n, c in keys.items()]).agg(
        F.min("ring").alias("ring")
    )
    group = ["win", "event_type"] + (["by"] if by is not None else [])
    return widen(per_actor, windows).groupBy(*group).agg(F.count("actor").alias("actors"))


def approx_actors(events: DataFrame, now_ms: int, windows=WINDOWS, rsd: float = 0.02) -> DataFrame:
    """Sketch-based variant for feeds where an approximate count is enough."""
    return (
        widen(ringed(events, now_ms, windows).select("ring", "event_type", actor().alias("actor")), windows)
        .groupBy("win", "event_type").agg(F.approx_count_distinct("actor", rsd).alias("actors"))
    )


def step_actors(events: DataFrame, now_ms: int, windows=WINDOWS) -> DataFrame:
    steps = parsed(events).filter(F.col("event_type") == "quiz_step_completed")
    return distinct_actors(steps, now_ms, windows, by=prop("step").cast("int")).select(
        "win", F.col("by").alias("step"), "actors"
    )


def median_duration(events: DataFrame, now_ms: int, windows=WINDOWS) -> DataFrame:
    done = ringed(parsed(events).filter(F.col("event_type") == "quiz_completed"), now_ms, windows)
    counted = done.groupBy("ring", prop("durationMs").cast("long").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return exact_median(widen(counted, windows), ["win"], "d", "median_ms", count="n")


def funnel(events: DataFrame, now_ms: int, windows=WINDOWS) -> DataFrame:
    """One row per window; the rate is NULL when nobody started."""
    kinds = {"quiz_started": "started", "quiz_completed": "completed", "deck_completed": "decks",
             "feed_viewed": "feed_viewers"}
    actors = distinct_actors(events.filter(F.col("event_type").isin(*kinds)), now_ms, windows)
    counted = actors.groupBy("win").agg(*[
        F.coalesce(F.max(F.when(F.col("event_type") == k, F.col("actors"))), F.lit(0)).alias(v)
        for k, v in kinds.items()
    ])
    names = events.sparkSession.createDataFrame([(n,) for n, _ in windows], "win string")
    medians = median_duration(events, now_ms, windows)
    return (
        names.join(counted, "win", "left").join(medians, "win", "left")
        .select("win", *[F.coalesce(v, F.lit(0)).alias(v) for v in kinds.values()], "median_ms")
        .withColumn("completion_rate", share(F.col("completed"), F.col("started")))
    )


def top_searches(events: DataFrame, now_ms: int, windows=WINDOWS, limit: int = TOP_SEARCHES) -> DataFrame:
    """Most frequent normalised searches; the limit applies before blank queries are dropped."""
    searches = ringed(parsed(events).filter(F.col("event_type") == "search_submitted"), now_ms, windows).select(
        "ring", F.lower(F.trim(prop("query"))).alias("query"), prop("resultCount").cast("int").alias("rc"),
        "created_ms", "id",
    )
    per_ring = searches.groupBy("ring", "query").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("rc") == 0).alias("zero"),
        F.max("rc").alias("most"),
        F.max_by(F.struct("rc"), F.struct("created_ms", "id")).alias("last"),
        F.max(F.struct("created_ms", "id")).alias("at"),
    )
    per_window = widen(per_ring, windows).groupBy("win", "query").agg(
        F.sum("n").alias("n"), F.sum("zero").alias("zero_results"), F.max("most").alias("most"),
        F.max_by("last", "at").alias("last"),
    )
    order = Window.partitionBy("win").orderBy(F.desc("n"), F.asc_nulls_first("query"))
    return (
        per_window.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= limit)
        .filter(F.col("query").isNotNull() & (F.col("query") != ""))
        .select("win", "query", "n", "zero_results", (F.coalesce("most", F.lit(0)) == 0).alias("always_zero"),
                F.coalesce(F.col("last.rc"), F.lit(0)).alias("last_results"))
    )


def usage(events: DataFrame, now_ms: int, event_type: str, field: str, windows=WINDOWS) -> DataFrame:
    """Histogram of one prop of one event type, missing values dropped."""
    rows = ringed(parsed(events).filter(F.col("event_type") == event_type), now_ms, windows)
    per_ring = rows.groupBy("ring", prop(field).alias(field)).agg(F.count(F.lit(1)).alias("n"))
    return widen(per_ring.filter(F.col(field).isNotNull()), windows).groupBy("win", field).agg(F.sum("n").alias("n"))


def filter_usage(events: DataFrame, now_ms: int, windows=WINDOWS) -> DataFrame:
    return usage(events, now_ms, "filter_applied", "kind", windows)


def swipe_mix(events: DataFrame, now_ms: int, windows=WINDOWS) -> DataFrame:
    """Verdict counts and like rate (a save counts as a like)."""
    per = usage(events, now_ms, "deck_swipe", "verdict", windows)
    out = per.groupBy("win").agg(*[
        F.coalesce(F.sum(F.when(F.col("verdict") == v, F.col("n"))), F.lit(0)).alias(f"{v}s")
        for v in ("like", "save", "dislike", "skip")
    ], F.sum("n").alias("total"))
    return out.withColumn("like_rate", share(F.col("likes") + F.col("saves"), F.col("total")))


def summary(events: DataFrame, now_ms: int, windows=WINDOWS) -> DataFrame:
    """All parts in one long table (win, section, key, value) for a dashboard payload.

    The events of the widest window are read and parsed once; the sections share the narrow table of them.
    """
    events = stage(parsed(ringed(events, now_ms, windows).drop("ring")).select("id", "created_ms", "event_type", "user_id", "anon_id", *[f"_{name}" for name in PROPS]), "events")

    def long(df: DataFrame, section: str, key: Column, value: Column) -> DataFrame:
        return df.select("win", F.lit(section).alias("section"), key.cast("string").alias("key"),
                         value.cast("double").alias("value"))

    funnel_ = funnel(events, now_ms, windows)
    swipes_ = swipe_mix(events, now_ms, windows)
    parts = [
        long(event_counts(events, now_ms, windows), "event_counts", F.col("event_type"), F.col("n")),
        long(step_actors(events, now_ms, windows), "step_actors", F.col("step"), F.col("actors")),
        long(top_searches(events, now_ms, windows), "top_searches", F.col("query"), F.col("n")),
        long(filter_usage(events, now_ms, windows), "filter_usage", F.col("kind"), F.col("n")),
    ]
    for df, section in ((funnel_, "funnel"), (swipes_, "swipes")):
        fields = [c for c in df.columns if c != "win"]
        pairs = F.explode(F.array(*[
            F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in fields
        ])).alias("p")
        flat = df.select("win", pairs)
        parts.append(long(flat, section, F.col("p.key"), F.col("p.value")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
