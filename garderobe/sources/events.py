"""Event intake: a closed whitelist of types and props, rejects with a reason, and the dated append sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERY_MAX = 200

# Event type -> prop -> rule. A number rule is (low, high), a list is an enum, "bool" and ("text", max) speak for
# themselves; a trailing ? marks an optional prop.
VERDICTS = ["like", "dislike", "save", "skip"]
CONTEXTS = ["calibration", "feed", "search"]
RULES = {
    "quiz_started": {}, "quiz_step_completed": {"step": (1, 20)}, "quiz_completed": {"durationMs": (0, 7_200_000)},
    "deck_swipe": {"verdict": VERDICTS, "index": (0, 99), "batch?": (0, 9)},
    "deck_completed": {"likes?": (0, 99), "cardsSeen?": (0, 99), "reason?": ["target", "cap", "skip", "exhausted"]},
    "deck_image_error": {"position": (0, 19)}, "feed_viewed": {"page": (0, 999)},
    "search_submitted": {"query": ("text", QUERY_MAX), "interpreted": "bool", "resultCount": (0, None)},
    "filter_applied": {"kind": ("text", 40)}, "listing_viewed": {"source": ("text", 64)}, "listing_saved": {"context": CONTEXTS},
    "listing_unsaved": {}, "fit_check_submitted": {"parsed": "bool", "inCatalog": "bool"}, "fit_check_result_clicked": {},
    "color_analysis_started": {"method": ["selfie", "quiz"]}, "color_analysis_completed": {"method": ["selfie", "quiz"]},
}


def _value_ok(name: str, rule) -> str:
    bare = name.rstrip("?")
    value = f"get_json_object(props, '$.{bare}')"
    if rule == "bool":
        ok = f"{value} in ('true', 'false')"
    elif isinstance(rule, list):
        ok = f"{value} in ({', '.join(repr(v) for v in rule)})"
    elif rule[0] == "text":
        ok = f"length({value}) between 1 and {rule[1]}"
    else:
        number = f"try_cast({value} as bigint)"
        ok = f"{number} >= {rule[0]}" + (f" and {number} <= {rule[1]}" if rule[1] is not None else "")
    return f"({value} is null or {ok})" if name.endswith("?") else f"coalesce({ok}, false)"


def reject_reason() -> Column:
    """NULL for a valid event, else type, props (unknown or missing names, or no object) or value."""
    keys = "json_object_keys(props)"
    cases = []
    for kind, props in RULES.items():
        names = ", ".join(f"'{p.rstrip('?')}'" for p in props)
        allowed = f"array({names})" if names else "cast(array() as array<string>)"
        values = " and ".join(_value_ok(p, r) for p, r in props.items()) or "true"
        cases.append(f"when event_type = '{kind}' then case when {keys} is null or size(array_except({keys}, {allowed})) > 0 then 'props' "
                     f"when not ({values}) then 'value' end")
    return F.expr("case " + " ".join(cases) + " else 'type' end")


def split_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid events, rejects with ``reason``); works on streams."""
    marked = events.withColumn("reason", reject_reason())
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())


def append_events(events: DataFrame, path: str) -> None:
    """Append to the event table, one partition per day; rows of a day are gathered so files stay large."""
    dated = events.withColumn("day", F.to_date("ts"))
    dated.repartition("day", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("append").partitionBy("day").parquet(path)
