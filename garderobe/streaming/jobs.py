"""Stream twins of the event plans."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from garderobe.operators.folds import clamped_fold
from garderobe.operators.joins import clickouts
from garderobe.plans.deck import CARD_CAP, LIKE_TARGET
from garderobe.plans.errors import SPIKE_THRESHOLD, fingerprinted
from garderobe.plans.ingest import hashed, first_of_each, next_snapshot, split_valid
from garderobe.plans.taste import tag_steps
from garderobe.sources.events import split_events
from garderobe.streaming.runtime import latest_state, millis, place, run, to_table
from garderobe.streaming.state import StateTable
from garderobe.values import SWIPE_PRESETS


def error_hours(errors: DataFrame, home: str | None = None) -> DataFrame:
    """Running count per (fingerprint, hour); the hour counter starts anew with each hour, rows later than two hours drop."""
    rows = fingerprinted(errors).withWatermark("ts", "2 hours")
    counts = rows.groupBy("stack_hash", F.window("ts", "1 hour").alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))
    flat = counts.select("stack_hash", millis(F.col("w.start")).alias("hour_ms"), "n", "first_ms", "last_ms")
    return latest_state(flat, "error-hours", ["stack_hash", "hour_ms"], home)


def error_totals(hours: DataFrame) -> DataFrame:
    """Group totals from the hourly sink."""
    return hours.groupBy("stack_hash").agg(F.sum("n").alias("count"), F.min("first_ms").alias("first_seen_ms"),
                                           F.max("last_ms").alias("last_seen_ms"), F.max_by("n", "hour_ms").alias("hour_count"))


def error_spikes(errors: DataFrame, threshold: int = SPIKE_THRESHOLD, home: str | None = None) -> DataFrame:
    """Two-hour windows, sliding by one, whose count reached the threshold."""
    counts = errors.withWatermark("ts", "2 hours").groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    flat = counts.select(millis(F.col("w.start")).alias("start_ms"), millis(F.col("w.end")).alias("end_ms"), "n")
    return latest_state(flat, "error-spikes", ["start_ms", "end_ms"], home).filter(F.col("n") >= threshold)


def style_vectors(swipes: DataFrame, vectors: DataFrame, preset: str = "live", home: str | None = None) -> DataFrame:
    """Learned (user_id, tag, value) after each micro-batch's swipes were folded onto the state so far.

    The state is a table in buckets of users (``StateTable``): a batch reads and writes the buckets of its users only, and a replay gives
    the same rows. Small weights are dropped from the result only, so it does not depend on where batches were cut.
    """
    spark, rule = swipes.sparkSession, SWIPE_PRESETS[preset]
    state = StateTable(spark, place(spark, "style-state", home), ["user_id"], f"user_id {swipes.schema['user_id'].dataType.simpleString()}, tag string, value double")

    def fold(before: DataFrame, steps: DataFrame) -> DataFrame:
        return clamped_fold(steps, ["user_id", "tag"], ["created_ms", "swipe_id"], "delta", -rule["clamp"], rule["clamp"], before)

    run(swipes, "style", lambda batch, batch_id: state.advance(tag_steps(batch, vectors, preset), batch_id, fold), home=home)
    return state.current().filter(F.round(F.abs("value"), 9) >= rule["prune"])


def attributed_events(events: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid events with known users attributed, rejects) as stream frames; a stream-static left join."""
    valid, rejects = split_events(events)
    known = users.select(F.col("user_id").cast("string").alias("user_id"), F.lit(True).alias("known_user"))
    return valid.join(known, "user_id", "left").withColumn("known_user", F.coalesce("known_user", F.lit(False))), rejects


SKETCH_BITS = 15  # 32,768 registers: a relative standard error of 1.04 / sqrt(32768), under 0.6 %; counts of a few thousand are all but exact
PANE_MS, PANES = 86_400_000, 7


def actor_panes(events: DataFrame, home: str | None = None) -> DataFrame:
    """(day_ms, event_type) -> events and a sketch of their actors, kept by the stream. An event may come up to seven days late."""
    panes = events.withWatermark("ts", "7 days").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(F.coalesce("user_id", "anon_id"), SKETCH_BITS).alias("sketch"))
    return latest_state(panes.select(millis(F.col("w.start")).alias("day_ms"), "event_type", "n", "sketch"), "panes", ["day_ms", "event_type"], home)


def over_panes(panes: DataFrame) -> DataFrame:
    """Events and distinct actors in seven-day windows sliding by a day, from the sketches of their days: an event is kept in one pane, and
    an actor of several days counts once. The actors are an estimate with the relative error of ``SKETCH_BITS``."""
    windows = panes.withColumn("end_ms", F.explode(F.transform(F.sequence(F.lit(1), F.lit(PANES)), lambda i: F.col("day_ms") + i * PANE_MS)))
    merged = windows.groupBy("end_ms", "event_type").agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("actors"))
    return merged.select("end_ms", "event_type", "n", "actors")


def rolling_actors(events: DataFrame, home: str | None = None) -> DataFrame:
    return over_panes(actor_panes(events, home))


def clickout_log(clicks: DataFrame, listings: DataFrame, home: str | None = None) -> DataFrame:
    return to_table(clickouts(clicks, listings), "clickouts", home=home)


def recheck_queue(clicks: DataFrame, listings: DataFrame, every: str = "15 minutes", home: str | None = None) -> DataFrame:
    """Listings to re-check, once per listing and interval however often they are clicked."""
    rows = clickouts(clicks, listings).withWatermark("ts", every).dropDuplicatesWithinWatermark(["listing_id"])
    return to_table(rows.select("listing_id", F.lit("clickout").alias("reason"), F.col("created_ms").alias("enqueued_ms")), "recheck", home=home)


def catalog_feed(batches: DataFrame, snapshot: DataFrame, home: str | None = None) -> DataFrame:
    """Catalog after upserting every micro-batch of raw listings: a batch rewrites the buckets of its listings.

    ``snapshot`` is what a new stream begins with; one that goes on keeps its own.
    """
    spark = batches.sparkSession
    state = StateTable(spark, place(spark, "snapshot", home), ["listing_id"], snapshot.schema)
    if not state.versions():
        state.write(snapshot, -1, {})

    def upsert(batch: DataFrame, batch_id: int) -> None:
        valid, _ = split_valid(batch)
        state.advance(hashed(first_of_each(valid)), batch_id, lambda before, new: next_snapshot(before, new).select(*snapshot.columns))

    run(batches, "catalog", upsert, home=home)
    return state.current()


def accepted_hits(hits: DataFrame, limit: int = 20, window_ms: int = 60_000, home: str | None = None) -> DataFrame:
    """Adds ``accepted`` to (key, hit_id, at_ms, ts): at most ``limit`` accepted hits per key in any window before a hit.

    The state is the accepted times still inside the window, never more than ``limit``; an event-time timer clears idle keys. A key's rows
    of one micro-batch are taken in time order, and the size of a micro-batch is bounded by the source's trigger options.
    """
    key_type = hits.schema["key"].dataType.simpleString()

    def decide(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(chunks)).sort_values(["at_ms", "hit_id"])
        verdicts = []
        for at in rows["at_ms"]:
            kept = [t for t in kept if t > at - window_ms]
            ok = len(kept) < limit
            if ok:
                kept.append(int(at))
            verdicts.append(ok)
        state.update((kept,))
        state.setTimeoutTimestamp(max(int(rows["at_ms"].iloc[-1]), state.getCurrentWatermarkMs()) + 2 * window_ms)
        yield pd.DataFrame({"key": [key[0]] * len(rows), "hit_id": rows["hit_id"].to_numpy(), "at_ms": rows["at_ms"].to_numpy(), "accepted": verdicts})

    timed = hits.select("key", "hit_id", "at_ms", "ts").withWatermark("ts", f"{window_ms} milliseconds")
    out = timed.groupBy("key").applyInPandasWithState(
        decide, f"key {key_type}, hit_id long, at_ms long, accepted boolean", "kept array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return to_table(out, "hits", home=home)


def deck_completions(swipes: DataFrame, home: str | None = None) -> DataFrame:
    """(user_id, reason, at_ms, positives, cards) once per user: the first moment the deck is complete.

    Of a user's rows in a micro-batch only the earliest that the deck has cards left for are held, chunk by chunk: a deck is complete
    with its last card at the latest, so later rows say nothing.
    """
    key_type = swipes.schema["user_id"].dataType.simpleString()

    def follow(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        likes, cards, over = state.get if state.exists else (0, 0, False)
        if over:
            return
        rows = None
        for chunk in chunks:
            rows = (chunk if rows is None else pd.concat([rows, chunk])).sort_values(["created_ms", "swipe_id"]).head(CARD_CAP - cards)
        up = rows["verdict"].isin(["like", "save"]).cumsum().to_numpy() + likes
        seen = pd.Series(range(1, len(rows) + 1)).to_numpy() + cards
        hit = ((up >= LIKE_TARGET) | (seen >= CARD_CAP)).nonzero()[0]
        if len(hit):
            at = hit[0]
            yield pd.DataFrame({"user_id": [key[0]], "reason": ["target" if up[at] >= LIKE_TARGET else "cap"],
                                "at_ms": [int(rows["created_ms"].iloc[at])], "positives": [int(up[at])], "cards": [int(seen[at])]})
        state.update((int(up[-1]), int(seen[-1]), bool(len(hit))))

    out = swipes.select("user_id", "swipe_id", "verdict", "created_ms").groupBy("user_id").applyInPandasWithState(
        follow, f"user_id {key_type}, reason string, at_ms long, positives long, cards long", "likes long, cards long, done boolean", "append",
        GroupStateTimeout.NoTimeout)
    return to_table(out, "decks", home=home)


def last_success(runs: DataFrame, home: str | None = None) -> DataFrame:
    """Latest successful start per source, kept current as runs arrive; staleness is its age when read."""
    return latest_state(runs.filter(F.col("status") == "ok").groupBy("source_id").agg(F.max("started_ms").alias("last_ok_ms")),
                        "last-ok", ["source_id"], home)


def stale_sources(last_ok: DataFrame, sources: DataFrame, now_ms: int, stale_hours: int = 30) -> DataFrame:
    live = sources.filter("enabled").select("source_id")
    return last_ok.join(live, "source_id", "left_semi").filter(F.lit(now_ms) - F.col("last_ok_ms") > stale_hours * 3_600_000)
