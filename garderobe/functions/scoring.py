"""Scores: similarity, freshness, palette and blends."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from garderobe.values import (
    EMBEDDING_WEIGHT,
    HALF_LIFE_DAYS_OTHER,
    HALF_LIFE_DAYS_RESALE,
    PALETTE_BOOST_MAX,
    PALETTE_HEX_DISTANCE,
    RELEVANCE_WEIGHTS,
    RERANK_WEIGHT,
    RESALE_SOURCE,
    SEARCH_WEIGHT,
)

DAY_MS = 86_400_000.0


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def sparse_dot(a: Column, b: Column) -> Column:
    return _sum(F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x * y, F.lit(0.0)))))


def sparse_norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(F.map_values(a), lambda v: v * v)))


def sparse_cosine(a: Column, b: Column) -> Column:
    scale = sparse_norm(a) * sparse_norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(sparse_dot(a, b) / scale)


def is_blank_vector(v: Column) -> Column:
    return v.isNull() | ~F.exists(F.map_values(v), lambda x: x != 0)


def attribute_similarity(taste: Column, attributes: Column) -> Column:
    """Cosine on 0..1; a blank side is neutral."""
    return F.when(is_blank_vector(taste) | is_blank_vector(attributes), F.lit(0.5)).otherwise(
        (sparse_cosine(taste, attributes) + 1) / 2
    )


def blend_similarity(attribute: Column, embedding: Column) -> Column:
    return F.when(embedding.isNull(), attribute).otherwise(
        EMBEDDING_WEIGHT * embedding + (1 - EMBEDDING_WEIGHT) * attribute
    )


def half_life_days(source_id: Column) -> Column:
    return F.when(source_id.rlike(RESALE_SOURCE), HALF_LIFE_DAYS_RESALE).otherwise(HALF_LIFE_DAYS_OTHER)


def freshness_decay(age_days: Column, half_life: Column) -> Column:
    return F.when(half_life <= 0, F.lit(0.0)).otherwise(
        F.exp(-math.log(2) * F.greatest(age_days, F.lit(0.0)) / half_life)
    )


def age_days(now_ms: int | Column, seen_ms: Column) -> Column:
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    return F.greatest((now - seen_ms) / DAY_MS, F.lit(0.0))


def hex_distance(a: Column, b: Column) -> Column:
    """Euclidean RGB distance; NULL when either side is not a six digit hex code."""
    def channels(code: Column) -> list[Column]:
        digits = F.regexp_extract(F.trim(code), r"(?i)^#?([0-9a-f]{6})$", 1)
        return [F.when(digits != "", F.conv(F.substring(digits, at, 2), 16, 10).cast("double")) for at in (1, 3, 5)]

    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(channels(a), channels(b))), F.lit(0.0)))


def palette_matches_color(palette: Column, color: Column) -> Column:
    def close(p: Column) -> Column:
        same_name = (p["name"] != "") & (F.lower(F.trim(p["name"])) == F.lower(F.trim(color["name"])))
        near = hex_distance(color["hex"], p["hex"]) <= PALETTE_HEX_DISTANCE
        return F.coalesce(same_name, F.lit(False)) | F.coalesce(near, F.lit(False))

    return F.exists(palette, close)


def palette_boost(palette: Column, colors: Column) -> Column:
    """1 to 1.25 by the fraction of the listing's colors that the palette covers."""
    hits = F.size(F.filter(colors, lambda c: palette_matches_color(palette, c)))
    blank = (F.coalesce(F.size(palette), F.lit(0)) <= 0) | (F.coalesce(F.size(colors), F.lit(0)) <= 0)
    return F.when(blank, F.lit(1.0)).otherwise(1 + (PALETTE_BOOST_MAX - 1) * (hits / F.size(colors)))


def palette_match(palette: Column, colors: Column) -> Column:
    return F.coalesce(F.exists(colors, lambda c: palette_matches_color(palette, c)), F.lit(False))


def base_score(similarity: Column, boost: Column, decay: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), similarity * boost * decay))


def blend_rerank(rank_score: Column, base: Column) -> Column:
    return RERANK_WEIGHT * rank_score + (1 - RERANK_WEIGHT) * base


def blend_search(relevance: Column, base: Column) -> Column:
    return SEARCH_WEIGHT * relevance + (1 - SEARCH_WEIGHT) * base


def rank_score(position: Column, n: Column) -> Column:
    """0-based position to 1..0; a single item scores 1."""
    return F.when(n <= 1, F.lit(1.0)).otherwise(1 - position / (n - 1))


def relevance(attribute: Column, semantic: Column, lexical: Column) -> Column:
    """Weighted mean over the components present; NULL when none is."""
    parts = {"attribute": attribute, "semantic": semantic, "lexical": lexical}
    total = sum((F.coalesce(RELEVANCE_WEIGHTS[k] * c, F.lit(0.0)) for k, c in parts.items()), F.lit(0.0))
    weight = sum((F.when(c.isNotNull(), RELEVANCE_WEIGHTS[k]).otherwise(0.0) for k, c in parts.items()), F.lit(0.0))
    return F.when(weight > 0, total / weight)


def fraction(hits: Column, n: Column) -> Column:
    """Fraction of ``n`` things wanted that were found; NULL where nothing is wanted."""
    return F.when(n > 0, F.coalesce(hits, F.lit(0)) / n)


# Pluggable similarity kinds: each takes a joined frame's columns and returns a 0..1 column.
SIMILARITY_KINDS = {
    "attribute": lambda c: attribute_similarity(c["style_tags"], c["attribute_vector"]),
    "embedding": lambda c: c["embedding_score"],
    "blend": lambda c: blend_similarity(attribute_similarity(c["style_tags"], c["attribute_vector"]),
                                        c["embedding_score"]),
}
