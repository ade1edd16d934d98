"""Search strings to filters and signals, as staged columns over a table of distinct queries.

Each rule takes its words out of the working text before the next one looks, so the order of the stages matters: price,
size, brand, gown, length, style words, shapes, necklines, fabrics, patterns, colors, occasions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garderobe import values as V
from garderobe.functions.text import collapse_spaces, lowered, needed, quoted
from garderobe.session import spread

# Fixed values.
STOPWORDS = ["a", "an", "the", "and", "or", "for", "with", "without", "in", "on", "of", "to", "me", "my", "i", "im", "i'm", "it", "that", "this", "some", "something", "someone", "please", "want", "need",
             "looking", "find", "show", "dress", "dresses", "clothes", "outfit"]
CONSTRAINT_WORDS = ["under", "over", "below", "above", "between", "less", "more", "than", "at", "least", "most", "max", "maximum", "min", "minimum", "up", "to", "and", "size", "sz", "us", "dollars", "bucks", "usd"]
MONEY = r"\$?\s?(\d{1,5}(?:\.\d{1,2})?)"
MONEY_END = r"(?:\s*(?:dollars|bucks|usd))?"
PRICE_RANGES = [
    rf"(?i)\bbetween\s+{MONEY}\s+and\s+{MONEY}{MONEY_END}",
    r"(?i)\$\s?(\d{1,5}(?:\.\d{1,2})?)\s*(?:-|–|—|to)\s*\$?\s?(\d{1,5}(?:\.\d{1,2})?)",
    r"(?i)(\d{1,5}(?:\.\d{1,2})?)\s*(?:-|–|—|to)\s*\$\s?(\d{1,5}(?:\.\d{1,2})?)",
]
PRICE_MAX = (r"(?i)\b(?:under|below|less\s+than|at\s+most|max(?:imum)?(?:\s+of)?|up\s+to|no\s+more\s+than|cheaper\s+than)\s+"
             + MONEY + MONEY_END)
PRICE_MIN = r"(?i)\b(?:over|above|more\s+than|at\s+least|min(?:imum)?(?:\s+of)?|starting\s+at)\s+" + MONEY + MONEY_END
SIZE = r"(?i)\b(?:size|sz|us)\s*(\d{1,2})\b"
GOWN = r"(?i)\b(?:ball[\s-]+|evening[\s-]+)?gowns?\b"
COLOR_SYNONYMS = [(r"\bcoral\b", "pink"), (r"\bfuchsia\b", "pink"), (r"\bmagenta\b", "pink"), (r"\bmint\b", "green"),
                  (r"\bturquoise\b", "blue"), (r"\baqua\b", "blue"), (r"\bindigo\b", "blue"), (r"\bmaroon\b", "red"),
                  (r"\bpeach\b", "orange"), (r"\bchampagne\b", "metallic")]
STYLE_WORDS = [
    (r"\bsundress(?:es)?\b", {"occasions": ["casual", "vacation"]}),
    (r"\b(?:lbd|little\s+black\s+dress)\b", {"colors": ["black"], "occasions": ["cocktail", "party"]}),
    (r"\bfunerals?\b", {"occasions": ["formal"], "colors": ["black"]}),
    (r"\bboho(?:[-\s]?chic)?\b|\bbohemian\b", {"patterns": ["floral"], "silhouettes": ["tent"]}),
    (r"\bcottage[-\s]?core\b", {"patterns": ["floral", "gingham"]}),
    (r"\bpreppy\b", {"patterns": ["gingham", "plaid"]}),
    (r"\bminimal(?:ist)?\b", {"patterns": ["solid"]}),
]
SOFT = {"occasions": "occasion", "colors": "color", "fabrics": "fabric", "silhouettes": "silhouette", "necklines": "neckline",
        "patterns": "pattern"}
EMPTY = "cast(array() as array<string>)"
SIGNAL = "struct<kind:string,term:string,value:string,hard:boolean>"


def _cents(text: Column) -> Column:
    return F.floor(F.nullif(text, F.lit("")).cast("double") * 100 + 0.5).cast("long")


def _take(df: DataFrame, pattern: str) -> DataFrame:
    return df.withColumn("_w", F.regexp_replace("_w", pattern, " "))


def _signals(kind: str, terms: Column | str, values: Column | str, hard: bool = False) -> Column:
    """Signals of one kind from the words that were read and what they stand for, place by place."""
    return F.zip_with(terms, values, lambda t, v: F.struct(
        F.lit(kind).alias("kind"), F.trim(t).alias("term"), v.alias("value"), F.lit(hard).alias("hard")))


def _first_of_each(signals: Column) -> Column:
    """A value of a kind counts once, by the first words that named it."""
    keys = F.transform(signals, lambda s: F.struct(s["kind"], s["value"]))
    return F.filter(signals, lambda s, i: F.array_position(keys, F.struct(s["kind"], s["value"])) == i + 1)


def _dollars(cents: Column) -> Column:
    return F.concat(F.lit("$"), F.floor(cents / 100 + 0.5).cast("string"))


def price_label(low: Column, high: Column) -> Column:
    """A price filter in words; one bound may be NULL."""
    return (F.when(low.isNotNull() & high.isNotNull(), F.concat(_dollars(low), F.lit("–"), _dollars(high)))
            .when(high.isNotNull(), F.concat(F.lit("under "), _dollars(high))).otherwise(F.concat(F.lit("over "), _dollars(low))))


def _price_signals(pattern: str, low: int | None, high: int | None) -> Column:
    """Every match of a price pattern; ``low`` and ``high`` name the groups that bound it."""
    def cents(group: int | None) -> Column:
        found = F.regexp_extract_all("_w", F.lit(pattern), F.lit(group or 0))
        return F.transform(found, lambda t: _cents(t) if group else F.lit(None).cast("long"))

    def label(pair: Column) -> Column:
        if low is None or high is None:
            return price_label(pair["lo"], pair["hi"])
        return price_label(F.least(pair["lo"], pair["hi"]), F.greatest(pair["lo"], pair["hi"]))

    bounds = F.zip_with(cents(low), cents(high), lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi")))
    return _signals("price", F.regexp_extract_all("_w", F.lit(pattern), F.lit(0)), F.transform(bounds, label), True)


def _take_table(df: DataFrame, table: list[tuple[str, str]], out: str) -> DataFrame:
    """Fold over a rule table: a rule that hits adds its value and blanks its words for the rules after it. The words that were
    read come as ``out`` with ``_terms`` at its end.

    Only rules whose words are in ``_low`` are asked; blanked words leave a space, so none of these words appears later.
    """
    words = [f"cast(array({', '.join(quoted(w) for w in needed(p))}) as array<string>)" for p, _ in table]
    rules = ", ".join(f"named_struct('p', {quoted('(?i)' + p)}, 'v', {quoted(v)}, 'n', {w})" for (p, v), w in zip(table, words))
    said = f"filter(array({rules}), r -> size(r.n) = 0 or exists(r.n, n -> contains(_low, n)))"
    fold = (f"aggregate({said}, named_struct('w', _w, 'hits', {EMPTY}, 'terms', {EMPTY}), (s, r) -> if(rlike(s.w, r.p), "
            "named_struct('w', regexp_replace(s.w, r.p, ' '), 'hits', array_append(s.hits, r.v), "
            "'terms', array_append(s.terms, regexp_extract(s.w, r.p, 0))), s))")
    return df.withColumn("_f", F.expr(fold)).withColumns(
        {"_w": F.col("_f.w"), out: F.col("_f.hits"), f"{out}_terms": F.col("_f.terms")}).drop("_f")


def _phrase(term: str) -> str:
    """SQL for the pattern of a literal phrase held in a column."""
    return f"concat('(?i)\\\\b\\\\Q', replace({term}, ' ', '\\\\E\\\\s+\\\\Q'), '\\\\E\\\\b')"


def _take_phrases(df: DataFrame, phrases: str, hits: str) -> DataFrame:
    """Fold over an array of phrases, keeping those that were still there when their turn came, and as they were written."""
    fold = (f"aggregate({phrases}, named_struct('w', _w, 'hits', {EMPTY}, 'terms', {EMPTY}), (s, g) -> if(rlike(s.w, {_phrase('g')}), "
            f"named_struct('w', regexp_replace(s.w, {_phrase('g')}, ' '), 'hits', array_append(s.hits, g), "
            f"'terms', array_append(s.terms, regexp_extract(s.w, {_phrase('g')}, 0))), s))")
    return df.withColumn("_f", F.expr(fold)).withColumns(
        {"_w": F.col("_f.w"), hits: F.col("_f.hits"), f"{hits}_terms": F.col("_f.terms")}).drop("_f")


def brand_grams(brands: DataFrame, anywhere: bool) -> DataFrame:
    """(gram, brand) for the 1 to 3 word sequences of each distinct brand: leading ones, or at any place."""
    words = F.filter(F.split(F.lower("brand"), r"\s+"), lambda w: w != "")
    starts = "sequence(1, size(w))" if anywhere else "array(1)"
    grams = F.expr(f"flatten(transform({starts}, i -> transform(filter(array(1, 2, 3), n -> i + n - 1 <= size(w)), "
                   "n -> array_join(slice(w, i, n), ' '))))")
    rows = brands.select("brand").distinct().withColumn("w", words).select("brand", F.explode(F.array_distinct(grams)).alias("gram"))
    stop = ", ".join(quoted(s) for s in STOPWORDS)
    return rows.filter(~F.expr(f"forall(split(gram, ' '), x -> x in ({stop}))"))


def known_brands(brands: DataFrame) -> DataFrame:
    """(gram, canonical, expanded): the shortest brand led by the gram, and all brands containing it."""
    lead = brand_grams(brands, anywhere=False).groupBy("gram").agg(
        F.min_by("brand", F.struct(F.length("brand"), "brand")).alias("canonical"))
    inside = brand_grams(brands, anywhere=True).groupBy("gram").agg(F.array_sort(F.collect_set("brand")).alias("expanded"))
    return lead.join(inside, "gram")


def _take_brands(df: DataFrame, brands: DataFrame) -> DataFrame:
    """Brand phrases of three, two, then one word; each round joins the text's word sequences with the brand table.

    The row travels with its word sequences and is folded back by query, so no round is computed twice.
    """
    known = known_brands(brands)
    df = df.withColumns({"brands": F.expr(EMPTY), "brand_names": F.expr(EMPTY), "_brand_signals": F.array().cast(f"array<{SIGNAL}>")})
    for n in (3, 2, 1):
        df = df.withColumn("_w", collapse_spaces(F.col("_w")))
        words = "filter(split(lower(_w), ' '), x -> x <> '')"
        grams = F.expr(f"transform(if(size({words}) >= {n}, sequence(1, size({words}) - {n - 1}), cast(array() as array<int>)), "
                       f"i -> array_join(slice({words}, i, {n}), ' '))")
        asked = df.select("query_id", F.struct(*[c for c in df.columns if c != "query_id"]).alias("_row"),
                          F.posexplode_outer(grams).alias("_at", "gram"))
        hit = F.when(F.col("canonical").isNotNull(), F.struct("_at", "gram", "canonical", "expanded"))
        df = asked.join(known, "gram", "left").groupBy("query_id").agg(
            F.first("_row").alias("_row"), F.array_sort(F.collect_list(hit)).alias("_found")
        ).select("query_id", "_row.*", "_found")
        df = _take_phrases(df, "array_distinct(transform(_found, x -> x.gram))", "_hits")
        used = F.expr("filter(_found, x -> array_contains(_hits, x.gram))")
        named = F.transform("_hits", lambda g: F.get(F.filter("_found", lambda x: x["gram"] == g), F.lit(0))["canonical"])
        df = df.withColumn("_used", used).withColumns({
            "_brand_signals": F.concat("_brand_signals", _signals("brand", "_hits_terms", named, True)),
            "brands": F.array_distinct(F.concat("brands", F.flatten(F.transform("_used", lambda x: x["expanded"])))),
            "brand_names": F.array_distinct(F.concat("brand_names", F.transform("_used", lambda x: x["canonical"]))),
        }).drop("_found", "_hits", "_hits_terms", "_used")
    return df


def interpret(queries: DataFrame, brands: DataFrame) -> DataFrame:
    """``queries`` (query_id, text[, lexical_terms]) with price, sizes, brands, length classes, soft signals, residual words
    and the text left for embedding. ``brands`` (brand) lists the catalog's brands.

    ``lexical_terms`` are terms that the searcher took back: they are words only. ``signals`` lists what was read, in the order of the
    rules: (kind, term as written, value, hard).
    """
    df = spread(queries, "query_id").withColumn("_w", F.coalesce("text", F.lit("")))
    if "lexical_terms" not in df.columns:
        df = df.withColumn("lexical_terms", F.expr(EMPTY))
    df = df.withColumn("_terms", F.expr(f"filter(transform(coalesce(lexical_terms, {EMPTY}), t -> lower(regexp_replace(trim(t), '\\\\s+', ' '))), t -> t <> '')"))
    df = _take_phrases(df, "_terms", "_forced")

    lows, highs, priced = [], [], []
    for i, pattern in enumerate(PRICE_RANGES):
        a, b = _cents(F.regexp_extract("_w", pattern, 1)), _cents(F.regexp_extract("_w", pattern, 2))
        read = {f"_lo{i}": F.least(a, b), f"_hi{i}": F.greatest(a, b), f"_range{i}": _price_signals(pattern, 1, 2)}
        df = _take(df.withColumns(read), pattern)
        priced.append(f"_range{i}")
        lows.append(f"_lo{i}")
        highs.append(f"_hi{i}")
    df = _take(df.withColumns({"_max": _cents(F.regexp_extract("_w", PRICE_MAX, 1)), "_under": _price_signals(PRICE_MAX, None, 1)}), PRICE_MAX)
    df = _take(df.withColumns({"_min": _cents(F.regexp_extract("_w", PRICE_MIN, 1)), "_over": _price_signals(PRICE_MIN, 1, None)}), PRICE_MIN)
    df = df.withColumns({"price_min_cents": F.coalesce(*lows, "_min"), "price_max_cents": F.coalesce(*highs, "_max")})
    sizes = F.transform(F.regexp_extract_all("_w", F.lit(SIZE), F.lit(1)), lambda s: s.cast("int"))
    said = _signals("size", F.regexp_extract_all("_w", F.lit(SIZE), F.lit(0)), sizes.cast("array<string>"), True)
    worn = F.transform(F.filter(said, lambda s: s["value"].cast("int") <= V.MAX_US_SIZE),
                       lambda s: s.withField("value", F.concat(F.lit("size "), s["value"])))
    df = _take(df.withColumns({"_sizes": worn, "sizes": F.array_distinct(F.filter(sizes, lambda s: s <= V.MAX_US_SIZE))}), SIZE)
    df = _take_brands(df, brands)
    df = df.withColumns({"semantic_text": collapse_spaces(F.col("_w")), "_low": lowered(F.col("_w"))})

    df = _take(df.withColumns({"_gown": F.col("_w").rlike(GOWN), "_gown_term": F.regexp_extract("_w", GOWN, 0)}), GOWN)
    df = _take_table(df, V.LENGTH_WORDS, "_lengths")
    style = {kind: [F.expr(EMPTY)] for kind in ("occasions", "colors", "patterns", "silhouettes")}
    for pattern, adds in STYLE_WORDS:
        for kind, found in adds.items():
            style[kind].append(F.when(F.col("_w").rlike("(?i)" + pattern), F.array(*[F.lit(v) for v in found]))
                               .otherwise(F.expr(EMPTY)))
    styled = []
    for pattern, adds in STYLE_WORDS:
        term = F.nullif(F.regexp_extract("_w", "(?i)" + pattern, 0), F.lit(""))
        for kind in (k for k in style if k in adds):
            found = F.when(term.isNotNull(), F.array(*[F.lit(v) for v in adds[kind]])).otherwise(F.expr(EMPTY))
            styled.append(_signals(SOFT[kind], F.array_repeat(term, F.size(found)), found))
    df = df.withColumns({f"_s_{kind}": F.concat(*parts) for kind, parts in style.items()} | {"_styled": F.concat(*styled)})
    df = _take_table(df, V.SILHOUETTE_WORDS, "_t_silhouettes")
    df = _take_table(df, V.NECKLINE_WORDS, "_t_necklines")
    df = _take_table(df, [(p, v.split()[0]) for p, v in V.FABRIC_WORDS], "_t_fabrics")
    df = _take_table(df, V.PATTERN_WORDS, "_t_patterns")
    df = _take_table(df, [(p, family) for p, _, family, _ in V.COLOR_WORDS] + COLOR_SYNONYMS, "_t_colors")
    df = _take_table(df, V.OCCASION_WORDS, "_t_occasions")

    stop = ", ".join(quoted(s) for s in STOPWORDS)
    noise = ", ".join(quoted(s) for s in STOPWORDS + CONSTRAINT_WORDS)
    forced = f"filter(flatten(transform(_forced, t -> split(t, ' '))), t -> not (t in ({noise})) and not rlike(t, '^\\\\$?[0-9]'))"
    residual = (f"array_distinct(concat(filter(split(lower(_w), '[^a-z0-9'']+'), t -> length(t) > 1 and not (t in ({stop}))), {forced}))")
    formal = F.when(F.col("_gown"), F.array(F.lit("formal"))).otherwise(F.expr(EMPTY))
    gown = F.when(F.col("_gown"), F.array(F.lit("maxi"), F.lit("floor"))).otherwise(F.expr(EMPTY))
    of_gown = F.when(F.col("_gown"), F.concat(
        _signals("length", F.array("_gown_term", "_gown_term"), F.array(F.lit("maxi"), F.lit("floor")), True),
        _signals("occasion", F.array("_gown_term"), F.array(F.lit("formal"))))).otherwise(F.array().cast(f"array<{SIGNAL}>"))
    tables = [_signals(SOFT[kind], f"_t_{kind}_terms", f"_t_{kind}") for kind in ("silhouettes", "necklines", "fabrics", "patterns", "colors", "occasions")]
    soft = F.concat(of_gown, _signals("length", "_lengths_terms", "_lengths", True), "_styled", *tables)
    signals = F.concat(*priced, "_under", "_over", "_sizes", "_brand_signals", "_soft_signals")
    df = df.withColumn("_soft_signals", soft).withColumn("_soft_signals", _first_of_each(F.col("_soft_signals")))
    return df.select(
        *queries.columns, "price_min_cents", "price_max_cents", "sizes", "brands", "brand_names",
        F.array_distinct(F.concat(gown, "_lengths")).alias("length_classes"),
        F.array_distinct(F.concat(formal, "_s_occasions", "_t_occasions")).alias("occasions"),
        F.array_distinct(F.concat("_s_colors", "_t_colors")).alias("colors"),
        F.array_distinct("_t_fabrics").alias("fabrics"),
        F.array_distinct(F.concat("_s_silhouettes", "_t_silhouettes")).alias("silhouettes"),
        F.array_distinct("_t_necklines").alias("necklines"),
        F.array_distinct(F.concat("_s_patterns", "_t_patterns")).alias("patterns"),
        F.expr(residual).alias("residual"), "semantic_text", signals.alias("signals"),
    )


def merge_parse(stage1: DataFrame, other: DataFrame, brands: DataFrame) -> DataFrame:
    """Fill gaps of the rule parse from another parse of the same queries (query_id, price_min_cents, price_max_cents, sizes,
    length_classes, brands, occasions, colors, fabrics, silhouettes, vibe_text).

    Hard fields are taken only where the rules found none; soft lists are united; unknown brand names never filter. What the searcher
    took back (``lexical_terms`` of ``stage1``) does not come back from the other parse: neither a price as it would be named, a size,
    a class, a brand, a soft value as given or as it would be stored, nor a word of the vibe. What is taken joins ``signals``.
    """
    hard = ["price_min_cents", "price_max_cents", "sizes", "length_classes", "brands"]
    soft = ["occasions", "colors", "fabrics", "silhouettes"]
    if "lexical_terms" not in stage1.columns:
        stage1 = stage1.withColumn("lexical_terms", F.expr(EMPTY))
    gone = F.array_compact(F.transform(F.coalesce("lexical_terms", F.expr(EMPTY)), lambda t: F.lower(F.trim(t))))

    def stays(*names: Column) -> Column:
        return ~F.arrays_overlap(gone, F.transform(F.array(*names), lambda n: F.lower(F.trim(n))))

    named = other.select("query_id", F.posexplode("brands").alias("_at", "_b")).withColumn(
        "gram", F.array_join(F.filter(F.split(F.lower("_b"), r"\s+"), lambda w: w != ""), " "))
    resolved = named.join(known_brands(brands), "gram").groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("_at", "_b", "canonical", "expanded"))).alias("_named"))
    o = other.select("query_id", *[F.col(c).alias(f"_o_{c}") for c in [*hard, *soft, "vibe_text"] if c != "brands"])
    rows = stage1.join(o, "query_id", "left").join(resolved, "query_id", "left")
    blank = F.expr(EMPTY)
    low, high = F.col("_o_price_min_cents"), F.col("_o_price_max_cents")
    no_price = F.col("price_min_cents").isNull() & F.col("price_max_cents").isNull()
    priced = no_price & (low.isNotNull() | high.isNotNull()) & stays(price_label(low, high))

    def added(name: str) -> Column:
        """Values of the other parse that are new to a soft list and were not taken back."""
        def stored(raw: Column) -> Column:
            return F.lower(raw) if name == "colors" else F.get(F.split(F.lower(raw), r"\s+"), F.lit(0)) if name == "fabrics" else raw

        kept = F.filter(F.coalesce(f"_o_{name}", blank), lambda raw: (stored(raw) != "") & stays(raw, stored(raw)))
        return F.array_except(F.transform(kept, stored), name)

    sizes = F.filter(F.coalesce("_o_sizes", F.array().cast("array<int>")), lambda s: s.between(0, V.MAX_US_SIZE)
                     & stays(s.cast("string"), F.concat(F.lit("size "), s.cast("string"))))
    lengths = F.filter(F.coalesce("_o_length_classes", blank), lambda c: stays(c))
    # Taken once as columns: fields and signals are made from the same lists.
    rows = rows.withColumns({
        "_priced": priced, "_sizes": F.when(F.size("sizes") == 0, sizes).otherwise(F.slice(sizes, 1, 0)),
        "_lengths": F.when(F.size("length_classes") == 0, lengths).otherwise(blank),
        "_named": F.when(F.size("brands") == 0, F.filter("_named", lambda x: stays(x["_b"]))),
        **{f"_new_{c}": added(c) for c in soft},
    })
    size_words = F.transform("_sizes", lambda s: F.concat(F.lit("size "), s.cast("string")))
    none = F.array().cast(f"array<{SIGNAL}>")
    label = F.array(price_label(low, high))
    vibe = F.array_join(F.filter(F.split(F.trim("_o_vibe_text"), r"\s+"), lambda w: stays(w)), " ")
    merged = {
        "price_min_cents": F.when(F.col("_priced"), low).otherwise(F.col("price_min_cents")),
        "price_max_cents": F.when(F.col("_priced"), high).otherwise(F.col("price_max_cents")),
        "sizes": F.array_distinct(F.concat("sizes", "_sizes")), "length_classes": F.concat("length_classes", "_lengths"),
        "brands": F.concat("brands", F.coalesce(F.array_sort(F.array_distinct(F.flatten("_named.expanded"))), blank)),
        **{c: F.concat(c, f"_new_{c}") for c in soft},
        "vibe_text": F.nullif(vibe, F.lit("")),
        "signals": F.concat(
            "signals", F.when(F.col("_priced"), _signals("price", label, label, True)).otherwise(none),
            _signals("size", size_words, size_words, True), _signals("length", "_lengths", "_lengths", True),
            F.coalesce(_signals("brand", "_named._b", "_named.canonical", True), none),
            *[_signals(SOFT[c], f"_new_{c}", f"_new_{c}") for c in soft]),
    }
    return rows.select(*[c for c in stage1.columns if c not in merged], *[v.alias(k) for k, v in merged.items()])


def wanted_tags(parsed: DataFrame) -> Column:
    """Soft signals as listing tags, e.g. color:red."""
    return F.expr("concat(" + ", ".join(
        f"transform({kind}, v -> concat('{prefix}:', split(lower(v), ' +')[0]))" for kind, prefix in SOFT.items()) + ")")
