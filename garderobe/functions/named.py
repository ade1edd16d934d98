"""Functions that SQL can call by name once ``register`` has put them into a session's catalog.

They are SQL functions: their bodies become part of the plan of the query that calls them, with no Python in it.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from garderobe.functions.text import quoted
from garderobe.values import CLASS_BELOW_INCHES, FX_TO_USD

_RATE = "case currency " + " ".join(f"when {quoted(code)} then {rate}D" for code, rate in FX_TO_USD.items()) + " else 1.0D end"
_CLASS = "case when inches is null then null " + " ".join(f"when inches < {below}D then {quoted(name)}" for below, name in CLASS_BELOW_INCHES) + " else 'floor' end"


def _references(text: str, pattern: str, base: int) -> str:
    """Each distinct reference of one base replaced by its character."""
    p = quoted(pattern)
    char = f"decode(unhex(lpad(hex(cast(conv(regexp_extract(r, {p}, 1), {base}, 10) as bigint)), 8, '0')), 'UTF-32')"
    return f"aggregate(array_distinct(regexp_extract_all({text}, {p}, 0)), {text}, (s, r) -> replace(s, r, {char}))"


# name -> (parameters, result, body)
FUNCTIONS = {
    "us_cents": ("cents bigint, currency string", "bigint", f"cast(floor(cents * {_RATE} + 0.5D) as bigint)"),
    "length_class_of": ("inches double", "string", _CLASS),
    "numeric_references": ("text string", "string", _references(_references("text", r"(?i)&#x([0-9a-f]+);", 16), r"&#(\d+);", 10)),
    "words_of": ("text string", "array<string>", "filter(split(lower(text), '\\\\s+'), t -> t <> '')"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session, anew if they were; NULL in, NULL out. Returns their names."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {result} return {body}")
    return list(FUNCTIONS)
