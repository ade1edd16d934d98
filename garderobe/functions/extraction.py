"""Attributes of a garment from its title and description, by rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garderobe import values as V
from garderobe.functions.hem import class_from_inches
from garderobe.functions.text import all_matches, child_audience, color_tags, first_match, lowered, may_match, quoted


def measurement_values(column: str, low: str | None = None) -> Column:
    """Array of inches, one slot per text rule; NULL where the rule is absent or implausible.

    Each rule's number and unit are cut out once into a struct; the arithmetic then runs on the struct's fields. ``low`` names the
    text's ``lowered`` column, where the rules' words are looked for first.
    """
    def cut(pattern: str, group: int) -> str:
        found = f"regexp_extract({column}, {quoted('(?i)' + pattern)}, {group})"
        return f"if({may_match(low, pattern)}, {found}, '')" if low else found

    hits = ", ".join(
        f"named_struct('number', {cut(pattern, 1)}, 'unit', lower({cut(pattern, 2)}), 'flat', {str(flat).lower()}, "
        f"'floor', {float(V.CIRCUMFERENCE_FLOOR.get(field, 0))}D, 'low', {float(V.PLAUSIBLE_INCHES[field][0])}D, "
        f"'high', {float(V.PLAUSIBLE_INCHES[field][1])}D)"
        for field, pattern, flat, _ in V.MEASUREMENT_RULES
    )
    flat_context = (f"{may_match(low, V.FLAT_CONTEXT)} and " if low else "") + f"{column} rlike {quoted('(?i)' + V.FLAT_CONTEXT)}"
    inches = (
        f"transform(array({hits}), h -> named_struct('h', h, 'v', cast(replace(nullif(h.number, ''), ',', '.') as double) / "
        "case when startswith(h.unit, 'cm') or startswith(h.unit, 'centimeter') then 2.54D else 1.0D end))"
    )
    doubled = (
        f"transform({inches}, x -> named_struct('h', x.h, 'v', floor(x.v * "
        f"case when x.h.flat or (x.v < x.h.floor and {flat_context}) then 2.0D else 1.0D end * 10.0D + 0.5D) / 10.0D))"
    )
    return F.expr(f"transform({doubled}, x -> case when x.v between x.h.low and x.h.high then x.v end)")


def measurements(values: Column) -> Column:
    """Struct (bust, waist, hip, length, from_waist) from the rule slots; the first plausible rule of a field wins."""
    def slots(field: str) -> list[Column]:
        return [values[i] for i, rule in enumerate(V.MEASUREMENT_RULES) if rule[0] == field]

    from_waist = next(i for i, rule in enumerate(V.MEASUREMENT_RULES) if rule[3])
    return F.struct(*[F.coalesce(*slots(f)).alias(f) for f in ("bust", "waist", "hip", "length")],
                    values[from_waist].isNotNull().alias("from_waist"))


def first_word(text: Column) -> Column:
    return F.element_at(F.split(F.trim(text), r"\s+"), 1)


def attribute_vector(length_class: str = "length_class", silhouette: str = "silhouette", colors: str = "colors",
                     pattern: str = "pattern", neckline: str = "neckline", occasions: str = "occasions",
                     fabric: str = "fabric", is_vintage: str | None = None) -> Column:
    """Sparse map tag -> weight, from the named columns."""
    w = V.TAG_WEIGHTS

    def one(kind: str, value: str) -> str:
        entry = f"array(named_struct('key', '{kind}:' || {value}, 'value', {w[kind]}D))"
        return f"if({value} is not null, {entry}, array())"

    def many(kind: str, values: str) -> str:
        return (f"transform(array_distinct({values}), v -> named_struct('key', '{kind}:' || v, "
                f"'value', {w[kind]}D))")

    parts = [
        one("length", length_class), one("silhouette", silhouette), many("color", f"transform({colors}, c -> c.family)"),
        one("pattern", f"nullif({pattern}, 'solid')"), one("neckline", neckline), many("occasion", occasions),
        one("fabric", f"split(trim({fabric}), ' +')[0]"),
    ]
    if is_vintage is not None:
        parts.append(one("era", f"if({is_vintage}, 'vintage', null)"))
    return F.expr(f"map_from_entries(concat({', '.join(parts)}))")


def hint(listings: DataFrame, name: str, kind: str) -> Column:
    """A field of the source's ``hints``; null where the source gives no hints, or none of that name."""
    given = listings.schema["hints"].dataType.names if "hints" in listings.columns else []
    return F.col("hints")[name].cast(kind) if name in given else F.lit(None).cast(kind)


def hinted_list(given: Column, found: Column) -> Column:
    return F.when(F.size(given) > 0, given).otherwise(found)


def extract(listings: DataFrame) -> DataFrame:
    """One extraction row per listing from ``title`` and ``description`` (a projection: no shuffle); what ``hints`` says wins, field by field."""
    word = lambda name, table: F.coalesce(hint(listings, name, "string"), first_match("_text", table, "_low"))
    given_colors = hint(listings, "colors", "array<struct<name:string,family:string>>")
    tagged = F.transform(given_colors, lambda c: F.struct(c["name"].alias("name"), c["family"].alias("family"), F.lit(None).cast("string").alias("hex")))
    text = F.concat(F.col("title"), F.lit("\n"), F.coalesce("description", F.lit("")))
    staged = listings.withColumn("_text", text).withColumn("_low", lowered(F.col("_text"))).withColumns({
        "_slots": measurement_values("_text", "_low"),
        "colors": hinted_list(tagged, color_tags("_text")),
        "silhouette": word("silhouette", V.SILHOUETTE_WORDS),
        "neckline": word("neckline", V.NECKLINE_WORDS),
        "sleeve": word("sleeve", V.SLEEVE_WORDS),
        "fabric": word("fabric", V.FABRIC_WORDS),
        "_pattern": first_match("_text", V.PATTERN_WORDS, "_low"),
        "occasions": hinted_list(hint(listings, "occasions", "array<string>"), all_matches("_text", V.OCCASION_WORDS, "_low")),
        "_phrase": F.when(F.contains("_low", F.lit("falls")), F.regexp_extract("_text", r"(?i)falls\s+to\s+an?\s+([a-z\s-]+?)\s+length", 1)),
        "_worded": first_match("_text", V.LENGTH_WORDS, "_low"),
        "audience": F.when(child_audience("title", "_low"), F.lit("child")),
    })
    staged = staged.withColumn("measurements", measurements(F.col("_slots")))
    m = F.col("measurements")
    staged = staged.withColumn("length_inches", F.coalesce(hint(listings, "length_inches", "double"), F.when(~m["from_waist"], m["length"])))
    staged = staged.withColumns({
        "length_class": F.coalesce(hint(listings, "length_class", "string"), first_match("_phrase", V.LENGTH_WORDS), "_worded", class_from_inches(F.col("length_inches"))),
        "length_basis": F.when(F.col("length_inches").isNotNull(), F.lit("stated")),
        "pattern": F.coalesce(hint(listings, "pattern", "string"), "_pattern", F.when(F.size("colors") > 0, F.lit("solid"))),
    })
    found = [
        F.col("length_class"), F.col("length_inches"), F.col("silhouette"), F.col("neckline"), F.col("sleeve"),
        F.col("fabric"), F.col("_pattern"), F.when(F.size("colors") > 0, F.lit(1)),
        F.coalesce(m["bust"], m["waist"], m["hip"]),
    ]
    n = sum((c.isNotNull().cast("int") for c in found), F.lit(0))
    conf = V.EXTRACT_CONFIDENCE
    return staged.withColumns({
        "confidence": F.least(F.lit(conf["cap"]), conf["base"] + conf["per_field"] * n),
        "attribute_vector": attribute_vector(),
    }).drop("_text", "_low", "_slots", "_pattern", "_phrase", "_worded")


EXTRACTED = [
    "length_class", "length_inches", "length_basis", "measurements", "colors", "fabric", "neckline", "silhouette",
    "sleeve", "pattern", "occasions", "audience", "attribute_vector", "confidence",
]
