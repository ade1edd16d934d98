"""Robust multivariate outliers: documents whose statistics are far from those of their language and source.

DataFrame functions only. The estimates are minimum-covariance-determinant fits: mean and covariance of the half of a group's distinct
texts that lies closest together, found by concentration steps from several robust shapes, of which the least determinant is kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from garderobe.session import stage

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = "[#*$%&|<>]"
RUN = 8  # words in a window
LEAST_WORDS, MOST_REPEATED = 20, 30  # base rules: words; per cent of words in repeated windows
LEAST_GROUP = 100  # smaller groups are pooled, first within the language, then all together; a smaller rest is not judged
SHARE = 0.5  # of a group in its concentrated part: up to as many outliers do not move the estimate
STEPS = 8
TAIL = 1e-4  # chance that a text of normal statistics is rejected
FLOORS = (0.06, 0.08, 0.12, 0.15, 0.12, 0.1)  # least spread of each statistic: rounding, or a symbol or two, is no outlier
P = len(FLOORS)
MOST_SENT = 20_000  # rows of numbers by group, a few MB
BINS = 24  # bins of distance to each factor of e: the concentrated part ends at a bin's end
MARGIN = P / BINS  # of log determinants: what a bin more or less makes
GRID = 500  # steps to one when medians are taken
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, also where ``use`` needs it for each element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def checked(groups: DataFrame) -> DataFrame:
    """A table with a row or a few for each group: sent to every executor if it has at most ``MOST_SENT`` rows, else joined as Spark plans it."""
    return F.broadcast(groups) if groups.limit(MOST_SENT + 1).count() <= MOST_SENT else groups


# --- statistics of a text ---------------------------------------------------------------------------------------


def repeated_words(words: Column) -> Column:
    """Words that lie in windows of ``RUN`` words found twice or more."""
    def doubled(hashes: Column, apart: int) -> Column:
        """Hashes of stretches twice as long: of each stretch and the one that begins ``apart`` words later."""
        later = F.slice(hashes, F.lit(apart + 1), F.greatest(F.size(hashes) - apart, F.lit(0)))
        return F.zip_with(F.slice(hashes, F.lit(1), F.size(later)), later, lambda a, b: F.xxhash64(a, b))

    twos = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: doubled(h, 1))
    fours = let(twos, lambda h: doubled(h, 2))
    windows = let(fours, lambda h: doubled(h, RUN // 2))
    hashes = F.when(F.size(words) < RUN, F.array().cast("array<bigint>")).otherwise(windows)

    def covered(sorted_: Column) -> Column:
        n = F.size(sorted_)
        twin = lambda k: (F.get(sorted_, k)["h"] == F.get(sorted_, k + 1)["h"]) | (F.get(sorted_, k)["h"] == F.get(sorted_, k - 1)["h"])
        twins = F.filter(F.sequence(F.lit(0), n - 1), lambda k: F.coalesce(twin(k), F.lit(False)))
        starts = F.array_sort(F.transform(twins, lambda k: F.get(sorted_, k)["i"]))
        begin = F.struct(F.lit(-RUN).alias("last"), F.lit(0).alias("total"))
        return F.aggregate(starts, begin, lambda a, s: F.struct(s.alias("last"), (a["total"] + F.least(F.lit(RUN), s - a["last"])).alias("total")))["total"]

    def count(h: Column) -> Column:
        repeats = F.size(F.array_distinct(h)) < F.size(h)
        return F.when(repeats, let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered)).otherwise(0)

    return let(hashes, count)


def stuttered(words: Column) -> Column:
    """Words that stand before an equal word."""
    return F.size(F.filter(words, lambda w, i: F.coalesce(w == F.get(words, i + 1), F.lit(False))))


def text_statistics(text: Column) -> Column:
    """Struct of the counts of words, of their code points, of symbols, capitals, lines and repetitions; null is the empty text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    counted = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.aggregate(w, F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("word_chars"), repeated_words(w).cast("long").alias("n_repeat_words"), stuttered(w).alias("n_stutters")))
    dup = let(lines, lambda own: F.struct((F.size(own) - F.size(F.array_distinct(own))).cast("long").alias("n_dup_lines"), F.size(own).cast("long").alias("n_lines")))
    return F.struct(counted.alias("w"), F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"), F.regexp_count(text, F.lit("[A-Z]")).alias("n_capitals"), dup.alias("d"))


def with_statistics(docs: DataFrame) -> DataFrame:
    """Documents with ``_quality``: the counts, whether a base rule fails, and the transformed vector x0 to x5.

    The vector: log of the mean word length, smoothed by 20 words of 5 letters; square roots of symbols a word, of the shares of
    repeated lines, of repeated words and of words said twice in a row, and of capitals a letter. Roots and smoothing make short and
    long texts comparable.
    """
    counts = F.col("_counts")
    flat = {"n_words": counts["w"]["n_words"], "word_chars": counts["w"]["word_chars"], "n_symbols": counts["n_symbols"], "n_dup_lines": counts["d"]["n_dup_lines"], "n_repeat_words": counts["w"]["n_repeat_words"]}
    n = flat["n_words"] + 20
    x = [F.log((flat["word_chars"] + 100) / n), F.sqrt(flat["n_symbols"] / n), F.sqrt(flat["n_dup_lines"] / (counts["d"]["n_lines"] + 10)), F.sqrt(flat["n_repeat_words"] / n),
         F.sqrt(counts["w"]["n_stutters"] / n), F.sqrt(counts["n_capitals"] / (flat["word_chars"] + 100))]
    failed = (flat["n_words"] < LEAST_WORDS) | (100 * flat["n_repeat_words"] > MOST_REPEATED * flat["n_words"])
    fields = [c.alias(k) for k, c in flat.items()] + [failed.alias("base_failed")] + [c.alias(f"x{i}") for i, c in enumerate(x)]
    return docs.withColumn("_counts", text_statistics(F.col("text"))).withColumn("_quality", F.struct(*fields)).drop("_counts")


# --- groups -----------------------------------------------------------------------------------------------------


def group_names(rows: DataFrame) -> DataFrame:
    """(lang, source) -> group: the pair itself if it has ``LEAST_GROUP`` distinct texts that pass the base rules, else the rest of the language, else the rest."""
    sizes = stage(rows.filter("not _quality.base_failed").select("lang", "source", "_text").distinct().groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")), "group-sizes")
    rest = sizes.filter(F.col("n") < LEAST_GROUP).groupBy(F.col("lang").alias("_lang")).agg(F.sum("n").alias("_rest"))
    own, language = F.to_json(F.struct("lang", "source")), F.to_json(F.struct("lang"))
    name = F.when(F.col("n") >= LEAST_GROUP, F.concat(F.lit("source "), own)).when(F.col("_rest") >= LEAST_GROUP, F.concat(F.lit("language "), language)).otherwise(F.lit("rest"))
    named = sizes.join(rest, F.col("lang").eqNullSafe(F.col("_lang")), "left").select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), name.alias("group"))
    return stage(named, "groups")


def grouped(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Rows with their group; pairs of which no document passes the base rules have none."""
    return rows.join(checked(names), F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left").drop("_lang", "_source")


# --- estimates --------------------------------------------------------------------------------------------------


def chi_square(x: float, half_df: int) -> float:
    """Distribution of chi-square with an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(half_df))


def chi_square_point(p: float, half_df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, half_df) < p else (low, middle)
    return low


CONSISTENCY = SHARE / chi_square(chi_square_point(SHARE, P // 2), P // 2 + 1)  # the inner part of a normal group is narrower
CUT = chi_square_point(1 - TAIL, P // 2)


def medians(values: DataFrame) -> DataFrame:
    """(group, k, v) -> (group, k, middle): the middle value on a grid, from counts of the grid's values."""
    counts = values.groupBy("group", "k", F.round(F.col("v") * GRID).cast("long").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    listed = counts.groupBy("group", "k").agg(F.array_sort(F.collect_list(F.struct("g", "n"))).alias("grid"), F.sum("n").alias("all"))
    found = F.aggregate("grid", F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("long").alias("g")),
                        lambda a, x: F.struct((a["upto"] + x["n"]).alias("upto"), F.coalesce(a["g"], F.when((a["upto"] + x["n"]) * 2 >= F.col("all"), x["g"])).alias("g")))
    return listed.select("group", "k", (found["g"] / GRID).alias("middle"))


def start(fitted: DataFrame) -> DataFrame:
    """(group, start, m, s): medians and, from the medians of the distances to them, spreads.

    The first shape has no correlations; the others have those of the directions from the median and of the squashed distances, both of
    which bound what a far row does.
    """
    long = fitted.select("group", F.posexplode(F.array(*[F.col(f"x{i}") for i in range(P)])).alias("k", "v"))
    middle = stage(medians(long), "medians").withColumnsRenamed({"group": "_group", "k": "_k"})
    away = long.join(checked(middle), (F.col("group") == F.col("_group")) & (F.col("k") == F.col("_k"))).select("group", "k", F.abs(F.col("v") - F.col("middle")).alias("v"))
    spread = stage(medians(away).withColumnRenamed("middle", "spread"), "spreads")
    both = spread.join(middle, (F.col("group") == F.col("_group")) & (F.col("k") == F.col("_k")))
    pick = lambda c, i: F.max(F.when(F.col("k") == i, F.col(c)))
    wide = stage(both.groupBy(F.col("group").alias("_group")).agg(*[pick("middle", i).alias(f"m{i}") for i in range(P)], *[F.sqrt(F.pow(pick("spread", i) * 1.4826, 2) + FLOORS[i] ** 2).alias(f"w{i}") for i in range(P)]), "scales")
    means = [F.col(f"m{i}") for i in range(P)]
    plain = wide.select(F.col("_group").alias("group"), F.lit(0).alias("start"), *means, *[(F.pow(f"w{i}", 2) - FLOORS[i] ** 2 if i == j else F.lit(0.0)).alias(f"s{i}{j}") for i, j in PAIRS])
    scaled = fitted.join(checked(wide), F.col("group") == F.col("_group")).select("group", *means, *[F.col(f"w{i}") for i in range(P)], *[((F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"w{i}")).alias(f"z{i}") for i in range(P)])
    length = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)), F.lit(1e-12)))
    signs = {1: lambda i: F.col(f"z{i}") / length, 2: lambda i: F.tanh(F.col(f"z{i}"))}
    sums = [F.avg(f(i) * f(j)).alias(f"c{k}_{i}{j}") for k, f in signs.items() for i, j in PAIRS]
    turned = stage(scaled.groupBy("group", *[f"m{i}" for i in range(P)], *[f"w{i}" for i in range(P)]).agg(*sums), "correlations")
    for k in signs:
        # The correlations of the signs with the spreads of the medians.
        shape = [(F.col(f"c{k}_{i}{j}") / F.sqrt(F.greatest(F.col(f"c{k}_{i}{i}") * F.col(f"c{k}_{j}{j}"), F.lit(1e-12))) * F.col(f"w{i}") * F.col(f"w{j}")).alias(f"s{i}{j}") if i != j else (F.pow(f"w{i}", 2) - FLOORS[i] ** 2).alias(f"s{i}{j}") for i, j in PAIRS]
        plain = plain.unionByName(turned.select("group", F.lit(k).alias("start"), *means, *shape))
    return plain


def with_factors(shapes: DataFrame) -> DataFrame:
    """(group, start, m, s) -> + l: the lower triangle whose square is the covariance with the floors added."""
    out = shapes
    for i, j in PAIRS:
        done = sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        value = F.col(f"s{i}{j}") + (FLOORS[i] ** 2 if i == j else 0.0) - done
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(value, F.lit(FLOORS[i] ** 2 / 4))) if i == j else value / F.col(f"l{j}{j}"))
    return out.select(F.col("group").alias("_group"), "start", *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i, j in PAIRS])


def with_distance(rows: DataFrame, shapes: DataFrame, how: str = "inner", x: str = "x") -> DataFrame:
    """Rows with the squared Mahalanobis distance from their group's estimate."""
    out = rows.join(checked(shapes), F.col("group") == F.col("_group"), how)
    for i in range(P):
        done = sum((F.col(f"l{i}{k}") * F.col(f"_y{k}") for k in range(i)), F.lit(0.0))
        out = out.withColumn(f"_y{i}", (F.col(f"{x}{i}") - F.col(f"m{i}") - done) / F.col(f"l{i}{i}"))
    return out.withColumn("distance", sum((F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(P)), F.lit(0.0))).drop("_group", *[f"_y{i}" for i in range(P)], *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i, j in PAIRS])


def concentrated(fitted: DataFrame, shapes: DataFrame) -> DataFrame:
    """One concentration step from each shape: mean and covariance of the closest ``SHARE`` of each group.

    Rows are summed up by group and bin of distance in one pass; the bins up to the one that completes the share are then added.
    """
    bin_ = F.floor(F.log(F.col("distance") + 1e-9) * BINS).alias("bin")
    sums = [F.sum(f"x{i}").alias(f"t{i}") for i in range(P)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in PAIRS]
    binned = stage(with_distance(fitted, shapes).groupBy("group", "start", bin_).agg(F.count(F.lit(1)).alias("n"), *sums), "bins")
    listed = binned.groupBy("group", "start").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("all"))
    last = F.aggregate("bins", F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("long").alias("bin")),
                       lambda a, x: F.struct((a["upto"] + x["n"]).alias("upto"), F.coalesce(a["bin"], F.when(a["upto"] + x["n"] >= F.ceil(F.col("all") * SHARE), x["bin"])).alias("bin")))
    ends = listed.select(F.col("group").alias("_group"), F.col("start").alias("_start"), last["bin"].alias("_last"))
    inner = binned.join(ends, (F.col("group") == F.col("_group")) & (F.col("start") == F.col("_start")) & (F.col("bin") <= F.col("_last")))
    n = F.sum("n")
    means = [(F.sum(f"t{i}") / n).alias(f"m{i}") for i in range(P)]
    shape = [((F.sum(f"q{i}{j}") / n - F.sum(f"t{i}") / n * F.sum(f"t{j}") / n) * CONSISTENCY).alias(f"s{i}{j}") for i, j in PAIRS]
    return inner.groupBy("group", "start").agg(*means, *shape)


def least_determinant(shapes: DataFrame) -> DataFrame:
    """Of each group's estimates the one with the least determinant; of those within ``MARGIN`` of it the first."""
    size = sum((2 * F.log(f"l{i}{i}") for i in range(P)), F.lit(0.0))
    least = shapes.groupBy(F.col("_group").alias("_of")).agg(F.min(size).alias("_least"))
    near = shapes.join(least, F.col("_group") == F.col("_of")).filter(size <= F.col("_least") + MARGIN)
    columns = [c for c in shapes.columns if c not in ("_group", "start")]
    return near.groupBy("_group").agg(F.min_by(F.struct(*columns), "start").alias("own")).select("_group", "own.*")


def estimates(rows: DataFrame) -> DataFrame:
    """Means and factored covariances of all groups, from the distinct texts that pass the base rules."""
    fitted = rows.filter("group is not null and not _quality.base_failed").select("group", "_text", *[F.col(f"_quality.x{i}").alias(f"x{i}") for i in range(P)])
    fitted = fitted.groupBy("group", "_text").agg(*[F.first(f"x{i}").alias(f"x{i}") for i in range(P)]).drop("_text")
    large = fitted.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") >= LEAST_GROUP) | (F.col("group") != "rest")).select(F.col("group").alias("_large"))
    fitted = stage(fitted.join(checked(stage(large, "large")), F.col("group") == F.col("_large")).drop("_large"), "vectors")
    shapes = stage(with_factors(start(fitted)), "shapes")
    for _ in range(STEPS):
        shapes = stage(with_factors(concentrated(fitted, shapes)), "shapes")
    return stage(least_determinant(shapes), "shapes")


def judged(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Documents (``text``, ``lang``, ``source`` and any others) with ``_quality``, ``distance`` and ``kept``.

    ``columns``: those of the input to carry along; all if not given. Null languages and sources are values of their own. A null or
    empty text has no words and fails the base rules. All rows are judged, but the estimates count a text once in its group; ties in
    distance stand on the same side of every cut. Documents of a rest with fewer than ``LEAST_GROUP`` distinct texts are judged by the base rules alone and have no
    distance. An empty table gives an empty result. Input columns named ``_quality``, ``_text``, ``group``, ``distance`` or ``kept`` are dropped.
    """
    docs = docs.drop("_quality", "_text", "group", "distance", "kept")
    carried = list(dict.fromkeys([*(docs.columns if columns is None else columns), "lang", "source"]))
    rows = stage(with_statistics(docs).select(*carried, "_quality", F.xxhash64("text").alias("_text")), "statistics")
    rows = grouped(rows, group_names(rows))
    vector = {f"_quality_x{i}": F.col(f"_quality.x{i}") for i in range(P)}
    measured = with_distance(rows.withColumns(vector), estimates(rows), "left", "_quality_x").drop("_text", *vector)
    return measured.withColumn("kept", ~F.col("_quality.base_failed") & F.coalesce(F.col("distance") <= CUT, F.lit(True)))


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged_ = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return judged_.select("doc_id", *[F.col(f"_quality.{c}").alias(c) for c in counts], "kept", "distance", "group")
