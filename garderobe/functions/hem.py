"""Where a hem falls on a body of a given height."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from garderobe.functions.money import rounded
from garderobe.values import (
    CLASS_BELOW_INCHES,
    CLASS_PRIOR_INCHES,
    HEEL_FACTOR,
    HEM_BANDS,
    HEM_POSITIONS,
    SHOULDER_RATIO,
    STRETCH_DROP,
    WAIST_RATIO,
)


def hem_band(ratio: Column) -> Column:
    out = None
    for above, name in HEM_BANDS:
        out = F.when(ratio > above, name) if out is None else out.when(ratio > above, name)
    return out.otherwise("floor")


def class_from_inches(inches: Column) -> Column:
    out = None
    for below, name in CLASS_BELOW_INCHES:
        out = F.when(inches < below, name) if out is None else out.when(inches < below, name)
    return F.when(inches.isNotNull(), out.otherwise("floor"))


def class_prior(length_class: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, inches in CLASS_PRIOR_INCHES.items():
        out = F.when(length_class == name, F.lit(inches)).otherwise(out)
    return out


def known_length(inches: Column, length_class: Column) -> Column:
    """Struct (length, measured): the stated length if there is one, else the usual one of the class."""
    measured = inches.isNotNull() & (inches > 0)
    return F.struct(F.when(measured, inches).otherwise(class_prior(length_class)).alias("length"), measured.alias("measured"))


def hem_at(length: Column, measured: Column, height: Column, heel: Column | None = None, basis: Column | None = None,
           from_waist: Column | None = None, stretchy: Column | None = None) -> Column:
    """``hem`` of a length from ``known_length``, which joins of many pairs work out once per garment."""
    heel = F.lit(0.0) if heel is None else F.coalesce(heel, F.lit(0.0))
    known = (height > 0) & length.isNotNull()
    effective = height + heel * HEEL_FACTOR
    ratio = F.lit(SHOULDER_RATIO) if from_waist is None else F.when(from_waist, WAIST_RATIO).otherwise(SHOULDER_RATIO)
    above = ratio * effective - length
    if stretchy is not None:
        above = F.when(stretchy, above - STRETCH_DROP).otherwise(above)
    estimated = F.lit(False) if basis is None else F.coalesce(basis == "image_estimate", F.lit(False))
    return F.struct(
        F.when(known, hem_band(above / effective)).alias("position"),
        F.when(known, rounded(above, 2)).alias("above_floor"),
        F.when(known & measured, "measured_length").when(known, "length_class_prior").otherwise("none").alias("basis"),
        F.when(known & measured & ~estimated, "high").when(known, "medium").otherwise("low").alias("confidence"),
    )


def hem(inches: Column, length_class: Column, height: Column, heel: Column | None = None,
        basis: Column | None = None, from_waist: Column | None = None, stretchy: Column | None = None) -> Column:
    """Struct (position, above_floor, basis, confidence); unknown heights and lengths give an empty result."""
    known = known_length(inches, length_class)
    return hem_at(known["length"], known["measured"], height, heel, basis, from_waist, stretchy)


def adjacent_positions(position: Column) -> Column:
    """The position itself and its neighbours, in order."""
    order = F.array(*[F.lit(p) for p in HEM_POSITIONS])
    at = F.array_position(order, position).cast("int")
    start = F.greatest(at - 1, F.lit(1))
    stop = F.least(at + 1, F.lit(len(HEM_POSITIONS)))
    return F.when(at > 0, F.slice(order, start, stop - start + 1))


def hem_allowed(position: Column, wanted: Column, include_unknown: Column | bool = False) -> Column:
    """No preference passes everything; an unknown hem passes only when asked for."""
    unknown = include_unknown if isinstance(include_unknown, Column) else F.lit(include_unknown)
    return (
        F.when(F.coalesce(F.size(wanted), F.lit(0)) <= 0, F.lit(True))
        .when(position.isNull(), unknown)
        .otherwise(F.array_contains(wanted, position))
    )
