"""Vendor strings to brand names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns for vendor strings that are internal codes, not brands.
CODE = r"^[A-Za-z]{1,6}[-_]?\d{1,4}[A-Za-z]{0,2}$"
SEASON_CODE = r"\b(?:FW|SS|AW|PF|SP)[\s-]?\d{2,4}[A-Za-z]?\b"
SEASON_WORD = r"(?:FALL|AUTUMN|SPRING|SUMMER|WINTER|RESORT|HOLIDAY|CRUISE|PRE[\s-]?FALL|PRE[\s-]?SPRING|BRIDAL)"
YEAR = r"(?:['’]?\d{2}|(?:19|20)\d{2})"
SEASON_YEAR = (rf"(?i)\b{SEASON_WORD}\b[\s\S]{{0,40}}(?:^|\s){YEAR}\b|\b{YEAR}\b[\s\S]{{0,40}}\b{SEASON_WORD}\b")
MERCH = r"(?i)\b(?:SALE|PREORDER|PRE-ORDER|LATE ADDS|MARKDOWN|OUTLET)\b"
LEGAL = r"(?i)\b(?:PRIVATE LIMITED|PVT\.?\s?LTD\.?|LLC|GMBH|PTY\s?LTD|CO\.,?\s?LTD)\b"


def is_vendor_code(vendor: Column) -> Column:
    v = F.trim(F.coalesce(vendor, F.lit("")))
    hit = v == ""
    for pattern in (CODE, SEASON_CODE, SEASON_YEAR, MERCH, LEGAL):
        hit = hit | v.rlike(pattern)
    return hit


def resolved_brand(vendor: Column, display_name: Column, brand_name: Column, brand_mode: Column, known: Column) -> Column:
    """A known label inside the vendor string wins; single-brand stores and codes fall back to the store's own name."""
    v = F.trim(F.coalesce(vendor, F.lit("")))
    own = F.coalesce(brand_name, display_name)
    labels = F.filter(F.coalesce(known, F.array().cast("array<string>")), lambda b: F.rlike(
        v, F.concat(F.lit(r"(?i)(?:^|\W)\Q"), b, F.lit(r"\E(?:\W|$)"))))
    return (
        F.when((v != "") & (F.size(labels) > 0), F.get(labels, F.lit(0)))
        .when(F.coalesce(brand_mode, F.lit("multi")) == "single", own)
        .when(is_vendor_code(v), own)
        .otherwise(v)
    )
