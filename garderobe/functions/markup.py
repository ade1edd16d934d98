"""HTML and XML text as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMED = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def _code_points(text: Column, pattern: str, base: int) -> Column:
    """Numeric references of one base, each distinct one replaced by its character."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    digits = F.regexp_extract
    return F.when(~text.rlike(pattern), text).otherwise(F.aggregate(found, text, lambda acc, ref: F.replace(
        acc, ref, F.decode(F.encode(_char(F.conv(digits(ref, pattern, 1), base, 10).cast("long")), "UTF-8"), "UTF-8"))))


def _char(code: Column) -> Column:
    """Character of a code point: UTF-32 bytes decoded."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def decode_entities(text: Column) -> Column:
    """Numeric references first, then the named ones, the ampersand last."""
    out = _code_points(text, r"(?i)&#x([0-9a-f]+);", 16)
    out = _code_points(out, r"&#(\d+);", 10)
    for name, char in NAMED:
        out = F.regexp_replace(out, f"(?i){name}", char)
    return out


def strip_html(html: Column) -> Column:
    """Visible text: scripts and styles dropped, breaks and block ends as line ends, tags as blanks, entities decoded."""
    out = F.regexp_replace(html, r"(?is)<(style|script)[\s\S]*?</\1>", " ")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"(?i)</(p|div|li|h[1-6])>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    for name, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;|&apos;", "'")):
        out = F.regexp_replace(out, f"(?i){name}", char)
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(out, r"\s*\n\s*", "\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


TRACKING = r"(?i)^(utm_|fbclid|gclid|mc_|igsh|ref$|si$)"


def canonical_url(url: Column) -> Column:
    """URL without fragment and tracking parameters."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    base = F.regexp_extract(bare, r"^([^?]*)", 1)
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda kv: (kv != "") & ~F.regexp_extract(kv, r"^([^=]*)", 1).rlike(TRACKING))
    with_path = F.when(base.rlike(r"(?i)^[a-z]+://[^/]+$"), F.concat(base, F.lit("/"))).otherwise(base)
    return F.when(F.size(kept) > 0, F.concat(with_path, F.lit("?"), F.array_join(kept, "&"))).otherwise(with_path)


def affiliate_url(url: Column, campaign_id: Column) -> Column:
    """Marketplace partner parameters added to an item URL."""
    fixed = "mkcid=1&mkrid=711-53200-19255-0&campid="
    joint = F.when(F.contains(url, F.lit("?")), "&").otherwise("?")
    return F.concat(url, joint, F.lit(fixed), campaign_id, F.lit("&toolid=10001&mkevt=1"))


def og_image(html: Column) -> Column:
    patterns = [
        r"""(?i)<meta[^>]*property\s*=\s*["']og:image(?::secure_url)?["'][^>]*content\s*=\s*["']([^"']+)["']""",
        r"""(?i)<meta[^>]*content\s*=\s*["']([^"']+)["'][^>]*property\s*=\s*["']og:image(?::secure_url)?["']""",
    ]
    return F.coalesce(*[F.nullif(F.trim(F.replace(F.regexp_extract(html, p, 1), F.lit("&amp;"), F.lit("&"))), F.lit("")) for p in patterns])
