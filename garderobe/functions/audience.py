"""Category and audience gates for product text and size labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns.
DRESS = r"(?i)\bdress(es)?\b"
NOT_A_DRESS = (r"(?i)\bdress[ -](shirt|shoe|pant|sock|watch|belt)s?\b|\bdressing gown\b|\bdress(ing)? (robe|coat)\b")
OTHER_CATEGORY = (
    r"(?i)\b(top|tee|t-shirt|shirt|blouse|skirt|pant|trouser|jean|short|jumpsuit|romper|playsuit|sweater|knitwear|cardigan|jacket"
    r"|coat|blazer|swim|bikini|bag|tote|shoe|boot|sandal|belt|hat|scarf|jewel|earring|necklace|accessor|gift card)\b")
SIZE_LABEL = r"(?i)^(xxs|xs|s|m|l|xl|xxl|2xl|3xl|xs\/s|m\/l|one size|os|\d{1,2}|us ?\d{1,2}|uk ?\d{1,2}|eu ?\d{2})$"
CHILD = (
    r"(?i)\bgirl'?s\b(?!'?\s+(?:night|trip|weekend|getaway))|\bkid'?s\b"
    r"|(?<!\bstar\s)(?<!\bmoon\s)(?<!\bwild\s)(?<!\bflower\s)\bchild(?:ren)?(?:'s)?\b|\btoddlers?\b|\binfants?\b|\bnewborns?\b"
    r"|\btweens?\b|\byouth\b|\bjunior\s+girls\b"
    r"|\bbaby\b(?!\s+(?:blues?\b|pinks?\b|yellows?\b|greens?\b|doll\b|showers?\b|bump\b|soft\b|banana\b)|'s\s+breath)"
    r"|\bmini[\s-]?me\b|\bmomm?y[\s-]?(?:and|&|n)[\s-]?me\b|\bmatching\s+family\b|\b(?:young|little)\s+(?:girl|boy)s?\b")
KID_PAIR = r"^(\d{1,2})\s*/\s*(\d{1,2})$"
KID_OTHER = r"^([2-6]t|nb|\d{1,2}\s*(?:y|yrs?|years?)|\d{1,2}(?:\s*-\s*\d{1,2})?\s*m(?:o|os|onths?)?)$"


def is_dress_text(text: Column) -> Column:
    return F.coalesce(text.rlike(DRESS) & ~text.rlike(NOT_A_DRESS), F.lit(False))


def is_other_category(text: Column) -> Column:
    return F.coalesce(text.rlike(OTHER_CATEGORY), F.lit(False))


def is_dress_product(product_type: Column, tags: Column, title: Column) -> Column:
    """The stated type decides first, then any tag, then the title."""
    typed = F.trim(F.coalesce(product_type, F.lit("")))
    return (
        F.when((typed != "") & is_dress_text(typed), True)
        .when((typed != "") & is_other_category(typed), False)
        .when(F.exists(tags, is_dress_text), True)
        .otherwise(is_dress_text(title))
    )


def url_words(url: Column) -> Column:
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return F.regexp_replace(F.coalesce(F.try_url_decode(path), path), r"[-_/.]+", " ")


def is_dress_page(title: Column, category: Column, url: Column) -> Column:
    """Title, then category, then the words of the URL path."""
    cat = F.coalesce(category, F.lit(""))
    return (
        F.when(is_dress_text(title), True)
        .when((cat != "") & is_dress_text(cat), True)
        .when((cat != "") & is_other_category(cat), False)
        .when(is_other_category(title), False)
        .otherwise(is_dress_text(url_words(url)))
    )


def is_kid_size(label: Column) -> Column:
    v = F.lower(F.trim(label))
    a = F.nullif(F.regexp_extract(v, KID_PAIR, 1), F.lit("")).cast("int")
    b = F.nullif(F.regexp_extract(v, KID_PAIR, 2), F.lit("")).cast("int")
    return F.coalesce((a >= 1) & (b <= 16) & (b - a == 1), v.rlike(KID_OTHER))


def child_reason(text: Column, labels: Column) -> Column:
    """Why an item is for children: the matched word, or a majority of kid sizes; NULL for adults."""
    word = F.regexp_extract(text, f"({CHILD})", 1)
    kid = F.size(F.filter(labels, is_kid_size))
    return F.when(text.rlike(CHILD), F.concat(F.lit("keyword:"), F.lower(word))).when(
        (F.size(labels) > 0) & (kid * 2 > F.size(labels)), "kid_sizes")
