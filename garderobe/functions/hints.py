"""Coarse attribute hints from product text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from garderobe.functions.text import all_matches, first_match

# Fixed rule tables.
LENGTHS = [(r"\bmicro\b", "micro"), (r"\bmini\b", "mini"), (r"\bmidi\b", "midi"), (r"\bmaxi\b", "maxi"),
           (r"\bknee[- ]length\b", "knee"), (r"\bfloor[- ]length\b|\bgown\b", "floor")]
FABRICS = [(rf"\b{w}\b", w) for w in ("linen", "silk", "satin", "cotton", "denim", "velvet", "knit", "crochet")]
PATTERNS = [(rf"\b{w}\b", w) for w in ("floral", "stripe", "gingham", "polka dot", "leopard", "paisley", "plaid")]
OCCASIONS = [("wedding guest", "wedding_guest"), (r"\bbridal|bride\b", "bridal"), (r"\bparty|cocktail\b", "party"),
             (r"\bwork(wear)?|office\b", "work"), (r"\bvacation|holiday|resort|beach\b", "vacation"), (r"\bevening|formal\b", "evening")]
MARKET_LENGTHS = {"micro": "micro", "mini": "mini", "short": "mini", "above knee": "above_knee", "above knee, mini": "above_knee",
                  "knee": "knee", "knee length": "knee", "midi": "midi", "mid-calf": "mid_calf", "maxi": "maxi", "long": "maxi",
                  "floor length": "floor", "full-length": "floor"}
MARKET_COLORS = [("black|onyx|charcoal", "black"), ("white|ivory|cream|ecru", "white"), ("red|crimson|scarlet|burgundy|maroon|wine", "red"),
                 ("pink|blush|rose|fuchsia|magenta", "pink"), ("orange|rust|terracotta|coral|peach|apricot", "orange"),
                 ("yellow|gold|mustard|lemon", "yellow"), ("green|olive|sage|emerald|mint|forest", "green"),
                 ("blue|navy|cobalt|azure|denim|teal", "blue"), ("purple|violet|lavender|lilac|plum|mauve", "purple"),
                 ("brown|tan|camel|chocolate|taupe|beige|khaki|leopard", "brown"), ("gr[ae]y|silver", "gray")]


def text_hints(column: str) -> Column:
    return F.struct(first_match(column, LENGTHS).alias("length_class"), first_match(column, FABRICS).alias("fabric"),
                    first_match(column, PATTERNS).alias("pattern"), all_matches(column, OCCASIONS).alias("occasions"))


def market_length(value: Column) -> Column:
    key = F.lower(F.trim(value))
    out = F.lit(None).cast("string")
    for name, cls in MARKET_LENGTHS.items():
        out = F.when(key == name, cls).otherwise(out)
    return out


def market_color(name: Column) -> Column:
    out = None
    for pattern, family in MARKET_COLORS:
        hit = name.rlike("(?i)" + pattern)
        out = F.when(hit, family) if out is None else out.when(hit, family)
    return out.otherwise("multi")


def market_condition(condition_id: Column, text: Column) -> Column:
    """By numeric id where there is one; the text "like new" counts as new because that word is looked for first."""
    n = F.expr("try_cast(null as double)")
    n = F.coalesce(n, condition_id.try_cast("double"))
    t = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when((n >= 1000) & (n < 2000), "new").when((n >= 2000) & (n < 3000), "like_new").when(n == 3000, "good")
        .when((n > 3000) & (n < 6000), "fair")
        .when(t.contains("new"), "new").when(t.contains("excellent"), "like_new")
        .when(t.rlike("pre-owned|used|good"), "good").otherwise("unknown")
    )
