"""Size labels to US sizes and size compatibility."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from garderobe.values import (
    ALPHA_SIZES,
    FIT_SLACK,
    FIT_STRETCH,
    MAX_US_SIZE,
    SILHOUETTE_EASE,
    VINTAGE_SHIFT,
)

_EMPTY = "array<int>"


def _alpha_table() -> Column:
    return F.map_from_arrays(
        F.array(*[F.lit(name) for name in ALPHA_SIZES]),
        F.array(*[F.array(*[F.lit(s) for s in sizes]) for sizes in ALPHA_SIZES.values()]),
    )


def label_sizes(labels: Column) -> Column:
    """US sizes per label: even sizes stand alone, odd (junior) sizes straddle, alpha sizes come from a table."""
    alpha = r"^0+(?=[A-Z])"
    read = F.transform(labels, lambda label: F.struct(
        F.try_to_number(F.nullif(F.regexp_extract(F.trim(label), r"(?i)^(?:us\s*|size\s*)?0*(\d{1,2})$", 1), F.lit("")),
                        F.lit("99")).cast("int").alias("n"),
        F.regexp_replace(F.regexp_replace(F.upper(F.trim(label)), r"[\s.+]+$", ""), alpha, "").alias("alpha"),
    ))
    return F.transform(read, lambda r: (
        F.when(r["n"].isNull(), F.coalesce(F.try_element_at(_alpha_table(), r["alpha"]), F.array().cast(_EMPTY)))
        .when(r["n"] > MAX_US_SIZE, F.array().cast(_EMPTY))
        .when(r["n"] % 2 == 0, F.array(r["n"]))
        .otherwise(F.array(r["n"] - 1, r["n"] + 1))
    ))


def normalized_sizes(labels: Column) -> Column:
    """All labels of a listing to a sorted set of US sizes."""
    present = F.coalesce(labels, F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.flatten(label_sizes(present))))


def in_stock_labels(availability: Column) -> Column:
    return F.map_keys(F.map_filter(availability, lambda _, on: on))


def size_overlap(listing_sizes: Column, wanted: Column) -> Column:
    """Strict overlap; a listing of unknown size passes."""
    return (F.size(listing_sizes) == 0) | F.arrays_overlap(listing_sizes, wanted)


def measurements_fit(garment: Column, body: Column, silhouette: Column) -> Column:
    """TRUE or FALSE when at least one of bust, waist and hip is known on both sides, NULL otherwise."""
    ease = F.lit(SILHOUETTE_EASE["other"])
    for name, inches in SILHOUETTE_EASE.items():
        ease = F.when(silhouette == name, F.lit(inches)).otherwise(ease)
    verdicts = []
    for part in ("bust", "waist", "hip"):
        g, b = garment[part], body[part]
        verdicts.append(
            F.when(g.isNotNull() & b.isNotNull(), g.between(b - FIT_STRETCH, b + ease + FIT_SLACK))
        )
    known = F.array_compact(F.array(*verdicts))
    return F.when(F.size(known) > 0, F.forall(known, lambda v: v))


def size_compatible(sizes: Column, is_vintage: Column, garment: Column, silhouette: Column, wanted: Column,
                    body: Column) -> Column:
    """Measurements decide first, then labels; vintage labels are shifted down before comparison."""
    low, high = VINTAGE_SHIFT
    shifted = F.exists(sizes, lambda s: F.exists(wanted, lambda u: u.between(s - high, s - low)))
    by_label = (
        F.when(F.size(sizes) == 0, F.lit(True)).when(is_vintage, shifted).otherwise(F.arrays_overlap(sizes, wanted))
    )
    return F.when(F.size(wanted) == 0, F.lit(True)).otherwise(
        F.coalesce(measurements_fit(garment, body, silhouette), by_label)
    )


def size_verdict(wanted: Column, labels: Column, availability: Column) -> Column:
    """unknown / not_listed / in_your_size / listed_sold_out for one product and one shopper."""
    pairs = F.arrays_zip(labels.alias("label"), label_sizes(labels).alias("sizes"))
    listed = F.transform(F.filter(pairs, lambda p: F.arrays_overlap(p["sizes"], wanted)), lambda p: p["label"])
    open_ = F.exists(listed, lambda label: F.coalesce(availability[label], F.lit(True)))
    return (
        F.when((F.size(wanted) == 0) | (F.size(labels) == 0), F.lit("unknown"))
        .when(F.size(listed) == 0, F.lit("not_listed"))
        .when(open_, F.lit("in_your_size"))
        .otherwise(F.lit("listed_sold_out"))
    )
