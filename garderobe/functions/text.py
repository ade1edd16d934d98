"""Keyword tables, HTML cleanup and tokens as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from garderobe.values import CHILD_WORDS, COLOR_WORDS, MAX_COLORS

STRINGS = "array<string>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def quoted(value: str | None) -> str:
    """A SQL literal. Rule tables are rendered as SQL text: one parse instead of a call per rule."""
    if value is None:
        return "cast(null as string)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(text: Column, pattern: str) -> Column:
    return text.rlike("(?i)" + pattern)


def lowered(text: Column) -> Column:
    """The text with A-Z as a-z, which is what ``(?i)`` takes for equal; the column to look for ``needed`` words in."""
    return F.translate(text, UPPER, LOWER)


def needed(pattern: str) -> list[str]:
    """Lower-case words without spaces of which every match of the pattern, cases aside, holds at least one; none if no such words are known."""
    parser = re._parser  # type: ignore[attr-defined]

    def of(items) -> list[str]:
        found, run = [], ""
        for op, value in [*items, (None, None)]:
            if op is parser.LITERAL and 32 < value < 127:
                run += chr(value).lower()
                continue
            if op is parser.AT:
                continue
            found, run = found + [[run]] if run else found, ""
            if op is parser.SUBPATTERN:
                found.append(of(value[3]))
            elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT) and value[0] > 0:
                found.append(of(value[2]))
            elif op is parser.BRANCH:
                each = [of(b) for b in value[1]]
                found.append([w for words_ in each for w in words_] if all(each) else [])
        return max((f for f in found if f), key=lambda f: min(map(len, f)), default=[])

    return list(dict.fromkeys(of(parser.parse(pattern))))


def may_match(low: str, pattern: str) -> str:
    """SQL that is false only where the pattern cannot match: looking for its words is much cheaper. ``low`` holds the ``lowered`` text."""
    return "(" + (" or ".join(f"contains({low}, {quoted(w)})" for w in needed(pattern)) or "true") + ")"


def _hit(column: str, pattern: str, low: str | None = None) -> str:
    return (f"{may_match(low, pattern)} and " if low else "") + f"{column} rlike {quoted('(?i)' + pattern)}"


def first_match(column: str, table: list[tuple[str, str]], low: str | None = None) -> Column:
    """Value of the first rule of ``table`` found in the text column, NULL when none is; ``low`` names its ``lowered`` text."""
    rules = " ".join(f"when {_hit(column, p, low)} then {quoted(v)}" for p, v in table)
    return F.expr(f"case {rules} end")


def all_matches(column: str, table: list[tuple[str, str]], low: str | None = None) -> Column:
    """Values of every rule found, in table order, without repeats."""
    rules = ", ".join(f"case when {_hit(column, p, low)} then {quoted(v)} end" for p, v in table)
    return F.expr(f"array_distinct(array_compact(array({rules})))")


def color_tags(column: str) -> Column:
    """Up to three color structs in table order; a longer color name hides the shorter one inside it.

    One alternation pass finds every color word: long names come first in the table, so the leftmost-first match takes
    "hot pink" whole and never reports its "pink".
    """
    bodies = "|".join(p.replace(r"\b", "") for p, *_ in COLOR_WORDS)
    pattern = quoted(rf"(?i)\b({bodies})\b")
    names = ", ".join(quoted(name) for _, name, _, _ in COLOR_WORDS)
    tags = ", ".join(
        f"named_struct('name', {quoted(n)}, 'family', {quoted(f)}, 'hex', {quoted(h)})" for _, n, f, h in COLOR_WORDS
    )
    words_ = f"transform(regexp_extract_all({column}, {pattern}, 1), w -> replace(regexp_replace(lower(w), '\\\\s+', ' '), 'grey', 'gray'))"
    ranks = f"array_sort(array_distinct(transform({words_}, w -> cast(array_position(array({names}), w) as int))))"
    return F.expr(f"transform(slice(filter({ranks}, r -> r > 0), 1, {MAX_COLORS}), r -> element_at(array({tags}), r))")


def child_audience(column: str, low: str | None = None) -> Column:
    return F.expr(_hit(column, CHILD_WORDS, low))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


def token_and_match(query: Column, haystack: Column, limit: int | None = None) -> Column:
    """Every word of the query occurs literally in the haystack."""
    tokens = words(F.trim(query))
    if limit is not None:
        tokens = F.slice(tokens, 1, limit)
    hay = F.lower(haystack)
    return F.forall(tokens, lambda t: F.contains(hay, t))


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))
