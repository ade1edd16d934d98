"""Content hashes and error fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(title: Column, description: Column, price_cents: Column, images: Column, sizes: Column) -> Column:
    """sha256 over title|description|price|images|sizes."""
    return F.sha2(
        F.concat_ws("|", title, F.coalesce(description, F.lit("")), price_cents.cast("string"),
                    F.array_join(images, ","), F.array_join(sizes, ",")),
        256,
    )


def error_fingerprint(route: Column, message: Column, stack: Column) -> Column:
    """Same error, whatever its numbers: digits in the message become #, the top five frames lose their positions."""
    frames = F.filter(
        F.transform(F.split(F.coalesce(stack, F.lit("")), "\n"), lambda line: F.trim(line)), lambda line: line.startswith("at ")
    )
    bare = F.transform(
        F.slice(frames, 1, 5),
        lambda f: F.regexp_replace(F.regexp_replace(f, r":\d+:\d+\)?$", ""), r":\d+\)?$", ""),
    )
    return F.sha2(
        F.concat(route, F.lit("\n"), F.regexp_replace(message, r"\d+", "#"), F.lit("\n"), F.array_join(bare, "\n")), 256
    )


def destination_hash(affiliate_url: Column, source_url: Column) -> Column:
    return F.sha2(F.coalesce(affiliate_url, source_url), 256)


def set_fingerprint(ids: Column) -> Column:
    """Order-free fingerprint of an array of ids."""
    return F.sha2(F.to_json(F.array_sort(F.array_distinct(ids))), 256)
