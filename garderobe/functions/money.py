"""Money and rounding columns. Amounts are integer cents throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from garderobe.values import FX_TO_USD


def half_up(x: Column) -> Column:
    """Round half towards positive infinity, as integers."""
    return F.floor(x + F.lit(0.5)).cast("long")


def rounded(x: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def usd_cents(cents: Column, currency: Column) -> Column:
    """Native cents to US cents at fixed rates; an unknown currency counts one to one."""
    rate = None
    for code, value in FX_TO_USD.items():
        hit = currency == code
        rate = F.when(hit, F.lit(value)) if rate is None else rate.when(hit, F.lit(value))
    return half_up(cents * rate.otherwise(F.lit(1.0)))


def share(part: Column, whole: Column) -> Column:
    """Ratio that is NULL when the whole is zero."""
    return F.when(whole > 0, part / whole)
