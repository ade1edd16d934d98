"""Row predicates over the catalog, as columns; sets of ids stay joins."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garderobe.functions.money import usd_cents
from garderobe.functions.sizes import size_overlap
from garderobe.functions.text import token_and_match
from garderobe.values import FRESH_HOURS_BY_KIND, FRESH_HOURS_DEFAULT, RESALE_SOURCE

HOUR_MS = 3_600_000
VERIFIABLE_PREFIXES = ("shopify:", "jsonld:")


def active() -> Column:
    return F.col("removed_ms").isNull()


def adult() -> Column:
    return F.coalesce("audience", F.lit("adult")) != "child"


def fresh_hours(kind: Column) -> Column:
    out = F.lit(FRESH_HOURS_DEFAULT)
    for name, hours in FRESH_HOURS_BY_KIND.items():
        out = F.when(kind == name, hours).otherwise(out)
    return out


def within_freshness(listings: DataFrame, sources: DataFrame, now_ms: int, override_hours: int | None = None) -> DataFrame:
    """Rows seen within their source kind's window, or within one window for all."""
    if override_hours is not None:
        return listings.filter(F.col("last_seen_ms") >= now_ms - override_hours * HOUR_MS)
    cutoff = sources.select("source_id", (F.lit(now_ms) - fresh_hours(F.col("kind")) * F.lit(HOUR_MS).cast("long")).alias("_cutoff"))
    return listings.join(cutoff, "source_id").filter(F.col("last_seen_ms") >= F.col("_cutoff")).drop("_cutoff")


def possibly_sold(listings: DataFrame, sources: DataFrame, now_ms: int) -> DataFrame:
    """Adds ``possibly_sold``: removed, or unseen for longer than the source kind's window."""
    kinds = sources.select("source_id", "kind")
    late = F.col("last_seen_ms") < F.lit(now_ms) - fresh_hours(F.col("kind")) * F.lit(HOUR_MS).cast("long")
    return listings.join(kinds, "source_id", "left").withColumn(
        "possibly_sold", F.col("removed_ms").isNotNull() | late
    ).drop("kind")


def usd_price() -> Column:
    return usd_cents(F.col("price_cents"), F.col("currency"))


def price_between(low: int | None, high: int | None) -> Column:
    cond = F.lit(True)
    if low is not None:
        cond = cond & (usd_price() >= low)
    if high is not None:
        cond = cond & (usd_price() <= high)
    return cond


def brand_in(brands: list[str]) -> Column:
    return F.lower("brand").isin([b.lower() for b in brands])


def color_in(families: list[str]) -> Column:
    wanted = [f.lower() for f in families]
    return F.exists("colors", lambda c: F.lower(c["family"]).isin(wanted))


def verifiable_source(source_id: Column | None = None) -> Column:
    source_id = F.col("source_id") if source_id is None else source_id
    first, *rest = [source_id.startswith(p) for p in VERIFIABLE_PREFIXES]
    for cond in rest:
        first = first | cond
    return first


def excluding(df: DataFrame, ids: DataFrame, key: str = "listing_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def expand_sources(sources: DataFrame, wanted: list[str]) -> DataFrame:
    """Source ids behind the facet values: 'resale' and 'brand' stand for groups, anything else for itself."""
    resale = F.col("source_id").rlike(RESALE_SOURCE)
    cond = F.col("source_id").isin([w for w in wanted if w not in ("resale", "brand")])
    if "resale" in wanted:
        cond = cond | resale
    if "brand" in wanted:
        cond = cond | ~resale
    return sources.filter(cond).select("source_id")


def enabled_sources(sources: DataFrame) -> DataFrame:
    return sources.filter("enabled").select("source_id")


def placeholder_image(url: Column, hosts: tuple[str, ...] = ("placehold.co",)) -> Column:
    """True for placeholder hosts and for anything that is not a URL."""
    host = F.try_parse_url(url, F.lit("HOST"))
    return F.coalesce(host.isin(*hosts), F.lit(True))


@dataclass
class CandidateRequest:
    """The optional parts of a candidate query; None and [] mean "no condition"."""

    sizes: list[int] = field(default_factory=list)
    price_min_cents: int | None = None
    price_max_cents: int | None = None
    conditions: list[str] = field(default_factory=list)
    brands: list[str] = field(default_factory=list)
    color_families: list[str] = field(default_factory=list)
    length_classes: list[str] = field(default_factory=list)
    source_ids: list[str] = field(default_factory=list)
    query: str | None = None
    freshness_hours: int | None = None

    def predicate(self) -> Column:
        cond = active() & adult()
        if self.sizes:
            cond = cond & size_overlap(F.col("size_normalized"), F.array(*[F.lit(s) for s in self.sizes]))
        cond = cond & price_between(self.price_min_cents, self.price_max_cents)
        if self.conditions:
            cond = cond & F.col("condition").isin(self.conditions)
        if self.brands:
            cond = cond & brand_in(self.brands)
        if self.source_ids:
            cond = cond & F.col("source_id").isin(self.source_ids)
        if self.length_classes:
            cond = cond & F.col("length_class").isin(self.length_classes)
        if self.color_families:
            cond = cond & color_in(self.color_families)
        if self.query and self.query.strip():
            hay = F.concat_ws("\n", "title", "brand", "description")
            cond = cond & token_and_match(F.lit(self.query), hay, limit=8)
        return cond


def candidates(catalog: DataFrame, sources: DataFrame, now_ms: int, request: CandidateRequest) -> DataFrame:
    """Active, adult, fresh listings matching the request (before any cap)."""
    return within_freshness(catalog.filter(request.predicate()), sources, now_ms, request.freshness_hours)
