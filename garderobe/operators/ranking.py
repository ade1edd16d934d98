"""Row-number rankings: newest first, source-fair caps, latest rows and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garderobe.values import CANDIDATE_CAP


def newest() -> list[Column]:
    return [F.desc("last_seen_ms"), F.asc("listing_id")]


def newest_first(df: DataFrame, limit: int = CANDIDATE_CAP) -> DataFrame:
    return df.orderBy(*newest()).limit(limit)


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key. The filter sits on the window, so tasks drop losers before the shuffle."""
    numbered = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.filter(F.col(rank) <= n)


def brand_key(brand: Column | None = None) -> Column:
    brand = F.col("brand") if brand is None else brand
    return F.lower(F.trim(F.coalesce(brand, F.lit(""))))


def fair_rank(df: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """Rows that can be among the first ``cap`` of a source's brand round-robin, with that position as ``_rs``.

    Depth within (source, brand) comes first, then newest. A row deeper than ``cap`` in its brand or source has ``cap``
    rows of the same source before it, so both cuts are exact, and both run map-side as group limits.
    """
    deep = top_n(df.withColumn("_brand", brand_key()), [*keys, "source_id", "_brand"], newest(), cap, "_rb")
    return top_n(deep, [*keys, "source_id"], [F.asc("_rb"), *newest()], cap, "_rs").drop("_brand", "_rb")


def stratified_cap(df: DataFrame, keys: list[str] | None = None, cap: int = CANDIDATE_CAP) -> DataFrame:
    """Source-fair, brand-spread cap: round-robin over sources, inside a source round-robin over brands.

    ``keys`` caps each group (a user, a query) on its own; without keys the whole frame is one group and the last step is
    a distributed top-n instead of a window over everything.
    """
    keys = keys or []
    ranked = fair_rank(df, keys, cap)
    order = [F.asc("_rs"), *newest()]
    if not keys:
        return ranked.orderBy(*order).limit(cap).drop("_rs")
    return top_n(ranked, keys, order, cap, "_pos").drop("_rs", "_pos")


def latest_by(df: DataFrame, keys: list[str], order: Column, columns: list[str] | None = None) -> DataFrame:
    """The newest row per key by aggregation (combined map-side), not by sorting each key's rows."""
    rest = columns or [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def page(df: DataFrame, position: str, offset: int, limit: int) -> DataFrame:
    """A page of a frame that stores rank positions from 0."""
    return df.filter(F.col(position).between(offset, offset + limit - 1))
