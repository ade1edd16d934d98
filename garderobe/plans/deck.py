"""Calibration decks: exclusions learned from swipes, completion, and the deck sampler."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garderobe.session import stage

# Fixed values.
DECK_SIZE = 12
LIKE_TARGET = 5
CARD_CAP = 30
EXTENSION = 7
EXCLUDE_DISLIKES = 2
MOST_SENT = 200_000  # looks that are sent to every executor, some hundred bytes each


def positive() -> Column:
    return F.col("verdict").isin("like", "save")


def completion(swipes: DataFrame) -> DataFrame:
    """Per user: positives, cards seen, why the deck is done (target, cap or not yet) and the next batch size."""
    counts = swipes.groupBy("user_id").agg(F.count_if(positive()).alias("positives"), F.count(F.lit(1)).alias("cards"))
    return counts.select(
        "user_id", "positives", "cards",
        F.when(F.col("positives") >= LIKE_TARGET, "target").when(F.col("cards") >= CARD_CAP, "cap").alias("reason"),
        F.greatest(F.lit(0), F.least(F.lit(EXTENSION), CARD_CAP - F.col("cards"))).cast("int").alias("next_batch"))


def exclusions(swipes: DataFrame, catalog: DataFrame) -> DataFrame:
    """(user_id, kind, value) of silhouettes and leading colors disliked at least twice and never liked."""
    shown = catalog.select("listing_id", F.array_compact(F.array(
        F.when(F.col("silhouette").isNotNull(), F.struct(F.lit("silhouette").alias("kind"), F.col("silhouette").alias("value"))),
        F.when(F.size("colors") > 0, F.struct(F.lit("color").alias("kind"), F.get("colors", F.lit(0))["family"].alias("value"))),
    )).alias("attrs"))
    rows = swipes.join(shown, "listing_id").select("user_id", positive().alias("up"), F.explode("attrs").alias("a"))
    tally = rows.groupBy("user_id", "a.kind", "a.value").agg(F.count_if("up").alias("ups"), F.count_if(~F.col("up")).alias("downs"))
    return tally.filter((F.col("downs") >= EXCLUDE_DISLIKES) & (F.col("ups") == 0)).select("user_id", "kind", "value")


def _places(group: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """Place of every row in its group, from 0: by ``order``, the first one last to decide, then as the rows stand."""
    by = np.lexsort((*order, group))
    starts = np.flatnonzero(np.diff(group[by], prepend=-1))
    out = np.empty(len(by), np.int64)
    out[by] = np.arange(len(by)) - np.repeat(starts, np.diff(starts, append=len(by)))
    return out


def turns(deck: np.ndarray, source: np.ndarray, brand: np.ndarray) -> np.ndarray:
    """When a source's brand gets its next card, whichever card that will be, from 0 in each deck; cards stand by rank.

    ``deck``, ``source`` and ``brand`` are numbers from 0; one of a source names its deck too, one of a brand its source. A brand gets a turn
    for each of its cards. In a source all brands have their first turn before any has its second, and so with sources: both in order
    of their best rank. Turns depend on numbers of cards only, so they can be laid out beforehand for all decks of a batch.
    """
    at = np.arange(len(deck))

    def best(group: np.ndarray) -> np.ndarray:
        first = np.full(group.max(initial=-1) + 1, len(group))
        np.minimum.at(first, group, at)
        return first[group]

    in_source = _places(source, best(brand), _places(brand))
    return _places(deck, best(source), in_source)


def fill_turns(own: list[list[int]], shapes: list[int], combos: list[int], seen_shapes: set[int], seen_combos: set[int]) -> list[int]:
    """The card for each turn: of those left of its brand (``own``, by rank), the first of an unseen shape, else of an unseen combination, else the first.

    Shapes and combinations are numbers; the sets say which are seen already, and those of the cards are added.
    """
    chosen: dict[int, None] = {}
    for cards in own:
        left = [card for card in cards if card not in chosen]
        card = next((c for c in left if shapes[c] not in seen_shapes), None)
        if card is None:
            card = next((c for c in left if combos[c] not in seen_combos), left[0])
        chosen[card] = None
        seen_shapes.add(shapes[card])
        seen_combos.add(combos[card])
    return list(chosen)


def _codes(values: pa.Array) -> np.ndarray:
    """Values as numbers from 0; null is a value."""
    return values.dictionary_encode("encode").indices.to_numpy().astype(np.int64)


def deal(cards: pa.ListArray, n: int) -> pa.Array:
    """For each user the indices of the cards dealt, in order. Users' cards are structs (rank, source_id, spread, shape, combo, soft, seen)."""
    ends = cards.offsets.to_numpy().astype(np.int64)
    fields = dict(zip((f.name for f in cards.type.value_type), cards.values.slice(ends[0], ends[-1] - ends[0]).flatten(), strict=True))
    ends -= ends[0]
    user = np.repeat(np.arange(len(cards)), np.diff(ends))
    by = np.lexsort((fields["rank"].to_numpy(), user))
    soft, seen = (fields[c].to_numpy(zero_copy_only=False)[by] for c in ("soft", "seen"))
    shape, combo, source, spread = (_codes(fields[c])[by] for c in ("shape", "combo", "source_id", "spread"))
    deck = user * 4 + seen * 2 + soft
    source = np.unique(deck * (source.max(initial=0) + 1) + source, return_inverse=True)[1]
    brand = np.unique(source * (spread.max(initial=0) + 1) + spread, return_inverse=True)[1]
    turn = turns(deck, source, brand)
    strict = np.bincount(user[~seen & ~soft], minlength=len(cards))
    place = turn + np.where(soft, strict[user], 0)
    dealt = np.flatnonzero(~seen & (place < n))
    dealt = dealt[np.lexsort((place[dealt], user[dealt]))]
    by_brand = np.argsort(brand, kind="stable")
    upto = np.concatenate(([0], np.cumsum(np.bincount(brand)))).astype(np.int64)
    known: dict[int, list[int]] = {}
    for card in np.flatnonzero(seen).tolist():
        known.setdefault(int(user[card]), []).append(card)
    out, stop = [], np.searchsorted(user[dealt], np.arange(len(cards)), "right").tolist()
    own = [by_brand[a:b].tolist() for a, b in zip(upto[brand[dealt]], upto[brand[dealt] + 1], strict=True)]
    shapes, combos, at, done = shape.tolist(), combo.tolist(), by - ends[user[by]], 0
    for u, until in enumerate(stop):
        shown = known.get(u, ())
        out.append(at[fill_turns(own[done:until], shapes, combos, {shapes[c] for c in shown}, {combos[c] for c in shown})].astype(np.int32) if until > done else np.zeros(0, np.int32))
        done = until
    return pa.array(out, pa.list_(pa.int32()))


def calibration_deck(ranked: DataFrame, catalog: DataFrame, excluded: DataFrame | None = None, shown: DataFrame | None = None,
                     n: int = DECK_SIZE) -> DataFrame:
    """(user_id, card, listing_id) from each user's ranked pool (bounded by the candidate cap).

    ``excluded`` holds the learned exclusions, kept out while other items last; ``shown`` (user_id, listing_id) the cards
    already seen, whose shapes count as explored.

    Pairs that come by user stay where they are: all that is joined to them is sent (looks, up to ``MOST_SENT``) or joined by user, a user's
    seen cards of ``catalog`` as one list. A ``catalog`` of the listings in the pools alone keeps both short.
    """
    look = catalog.select(
        "listing_id", F.coalesce("silhouette", F.lit("unknown")).alias("shape"), F.col("silhouette").alias("_s"),
        F.get(F.transform("colors", lambda c: c["family"]), F.lit(0)).alias("_c"),
        F.concat_ws("|", F.coalesce("length_class", F.lit("null")), F.coalesce("silhouette", F.lit("null")),
                    F.coalesce(F.get(F.transform("colors", lambda c: c["family"]), F.lit(0)), F.lit("undefined"))).alias("combo"))
    look = stage(look.filter(F.col("listing_id").isNotNull()), "looks")
    rows = ranked.select("user_id", "listing_id", "rank", "source_id", "spread").join(F.broadcast(look) if look.limit(MOST_SENT + 1).count() <= MOST_SENT else look, "listing_id")
    if excluded is not None:
        per_user = excluded.groupBy("user_id").agg(
            F.collect_set(F.when(F.col("kind") == "silhouette", F.col("value"))).alias("_xs"),
            F.collect_set(F.when(F.col("kind") == "color", F.col("value"))).alias("_xc"))
        rows = rows.join(per_user, "user_id", "left").withColumn("soft", F.coalesce(
            F.array_contains("_xs", F.col("_s")), F.lit(False)) | F.coalesce(F.array_contains("_xc", F.col("_c")), F.lit(False)))
    else:
        rows = rows.withColumn("soft", F.lit(False))
    rows = rows.withColumn("seen", F.lit(False))
    if shown is not None:
        marks = shown.join(look.select("listing_id").distinct(), "listing_id", "left_semi").groupBy("user_id").agg(F.collect_set("listing_id").alias("_shown"))
        rows = rows.join(marks, "user_id", "left").withColumn("seen", F.coalesce(F.array_contains("_shown", F.col("listing_id")), F.lit(False)))
    dealt = F.arrow_udf(lambda cards: deal(cards, n), "array<int>")
    cards = F.collect_list(F.struct("rank", "source_id", "spread", "shape", "combo", "soft", "seen"))
    users = rows.groupBy("user_id").agg(cards.alias("_cards"), F.collect_list(F.struct("listing_id")).alias("_ids")).withColumn("_dealt", dealt("_cards"))
    return users.select("user_id", F.posexplode(F.transform("_dealt", lambda i: F.get("_ids", i)["listing_id"])).alias("card", "listing_id"))
