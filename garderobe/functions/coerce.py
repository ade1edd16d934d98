"""Repair of nearly valid extraction payloads: every field comes out in its type and vocabulary, or null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from garderobe import values as V

UNKNOWN_CONFIDENCE = 0.5
NUMBER_KINDS = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out one time, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def field(payload: Column, path: str) -> Column:
    return F.try_variant_get(payload, path, "variant")


def text_of(value: Column) -> Column:
    """A string that is a string in the payload and not empty."""
    return F.when(F.schema_of_variant(value) == "STRING", F.nullif(F.try_variant_get(value, "$", "string"), F.lit("")))


def number_of(value: Column) -> Column:
    """A number that is a number in the payload; digits in quotes are none."""
    return F.when(F.schema_of_variant(value).rlike(NUMBER_KINDS), F.try_variant_get(value, "$", "double"))


def word_of(value: Column, allowed: list[str]) -> Column:
    """A word of the vocabulary, other spellings of case, spaces and hyphens included; anything else is "other" where there is such a word."""
    other = F.lit("other" if "other" in allowed else None)

    def word(given: Column) -> Column:
        spelled = F.regexp_replace(F.trim(F.lower(given)), r"[\s-]+", "_")
        return F.when(given.isin(allowed), given).otherwise(once(spelled, lambda s: F.when(s.isin(allowed), s).otherwise(other)))

    def read(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        return once(kind, lambda k: F.when(v.isNull() | (k == "VOID"), None).otherwise(once(F.when(k == "STRING", F.try_variant_get(v, "$", "string")), word)))

    return once(value, read)


def items_of(value: Column) -> Column:
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))


def coerced(payload: Column) -> Column:
    """Struct of all fields from a JSON text, which is parsed once; null if the text is no JSON object."""
    return once(F.try_parse_json(payload), _fields)


def _fields(v: Column) -> Column:
    color = lambda c: F.struct(text_of(field(c, "$.name")).alias("name"), text_of(field(c, "$.family")).alias("family"), text_of(field(c, "$.hex")).alias("hex"))
    colors = F.filter(F.transform(items_of(field(v, "$.colors")), color), lambda c: c["name"].isNotNull() & c["family"].isNotNull())
    occasions = F.filter(F.transform(items_of(field(v, "$.occasions")), text_of), lambda o: o.isin(V.OCCASIONS))
    fields = F.struct(
        word_of(field(v, "$.lengthClass"), V.LENGTH_CLASSES).alias("length_class"), number_of(field(v, "$.lengthInches")).alias("length_inches"),
        F.struct(*[number_of(field(v, f"$.measurements.{m}")).alias(m) for m in ("bust", "waist", "hip", "length")]).alias("measurements"),
        colors.alias("colors"), text_of(field(v, "$.fabric")).alias("fabric"), word_of(field(v, "$.neckline"), V.NECKLINES).alias("neckline"),
        word_of(field(v, "$.silhouette"), V.SILHOUETTES).alias("silhouette"), word_of(field(v, "$.sleeve"), V.SLEEVES).alias("sleeve"),
        word_of(field(v, "$.pattern"), V.PATTERNS).alias("pattern"), occasions.alias("occasions"), word_of(field(v, "$.audience"), V.AUDIENCES).alias("audience"),
        F.coalesce(number_of(field(v, "$.confidence")), F.lit(UNKNOWN_CONFIDENCE)).alias("confidence"))
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), fields)
