"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from garderobe.llm.ranks import ranked
from garderobe.session import stage

WORD = r"[^\x20\x09-\x0D]+"
CEILING = 3  # no source is taken more than so many times
WEIGHTS = (1, 2, 3)  # weights of the sources by code point, over and over
SEED = "mix"


def size_in_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> + target: shares of the whole by weight, none above ``CEILING`` times its size.

    What a source cannot take is shared again by weight among the others until none is above; each round reads the small table of
    sources and brings three sums to the driver.
    """
    table = stage(ranked(sizes, [], [F.col("source").asc_nulls_last()], "_order").withColumn("_weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("_order") - 1) % len(WEIGHTS) + 1).cast("int")).cast("long")), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    cap, capped = F.col("source_size") * CEILING, F.lit(False)
    seen = -1
    while True:
        sums = table.agg(F.count_if(capped).alias("n"), F.sum(F.when(capped, cap).otherwise(0)).alias("full"), F.sum(F.when(capped, 0).otherwise(F.col("_weight"))).alias("weight")).first()
        left, weight = total - (sums.full or 0), sums.weight or 0
        share = (F.lit(left) * F.col("_weight")).cast("double") / F.lit(float(weight)) if weight else F.lit(0.0)
        if sums.n == seen:
            return table.withColumn("target", F.when(capped, cap.cast("double")).otherwise(share)).select("source", "source_size", "target")
        seen, left_, weight_ = sums.n, left, weight
        capped = F.lit(left_) * F.col("_weight") >= cap * F.lit(weight_)


def start_of(source: Column) -> Column:
    """The random offset in [0, 1) of a source: fixed by the seed and the name, so reruns agree."""
    named = F.concat(F.lit(SEED), F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source)))
    return F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def mix(docs: DataFrame, size: str = "size") -> DataFrame:
    """Adds ``source_size``, ``target`` and ``copies`` to documents with ``doc_id``, ``source`` and a column of sizes.

    Every document of a source is expected target / source size times. The expectations are summed up over the source's documents in
    order of size; one offset is added, and a document is taken once for each whole number its stretch of the sum passes: between the
    floor and the ceiling of its expectation. As neighbours have similar sizes, the words taken come near the target.

    Documents of size 0 are placed like the others and add nothing; a null source is a source of its own; repeated rows are separate
    documents; a null ``doc_id`` is a place in the order like any other; an empty table gives an empty result. Other columns pass
    through; input columns named ``source_size``, ``target`` or ``copies`` are replaced.
    """
    docs = docs.drop("source_size", "target", "copies")
    named = source_targets(docs.groupBy("source").agg(F.sum(size).alias("source_size")))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = stage(named.withColumn("_expected", expected).withColumnRenamed("source", "_source"), "targets")
    tie = F.md5(F.concat(F.lit(SEED), F.col("doc_id").cast("string")))
    placed = ranked(docs, ["source"], [F.col(size).asc(), tie.asc_nulls_last(), F.col("doc_id").asc_nulls_last()], "_rank").join(targets, F.col("source").eqNullSafe(F.col("_source")))
    reached = lambda rank: F.floor(start_of(F.col("source")) + F.col("_expected") * rank)
    return placed.withColumn("copies", reached(F.col("_rank")) - reached(F.col("_rank") - 1)).drop("_rank", "_source", "_expected")


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as many times as it is taken, without the columns that ``mix`` added."""
    again = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return mixed.filter("copies > 0").withColumn("_copy", again).drop("_copy", "source_size", "target", "copies")


def mix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mix(docs.select("doc_id", "source", size_in_words(F.col("text")).alias("size")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


MIX_SQL = r"""
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM sized GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source_size * 3.0 / w, source NULLS LAST) AS k FROM s0),
s2 AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS remaining,
       CAST(sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS weight FROM s1),
cut AS (SELECT min(k) AS k FROM s2 WHERE remaining * w < 3 * source_size * weight),
level AS (SELECT remaining, weight, s2.k FROM s2 JOIN cut ON s2.k = cut.k),
s3 AS (SELECT s2.source, source_size, CASE WHEN level.k IS NULL OR s2.k < level.k THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(level.remaining * s2.w AS DOUBLE) / level.weight END AS target FROM s2 LEFT JOIN level ON true),
placed AS (SELECT d.doc_id, d.source, d.size, s3.source_size, s3.target, CASE WHEN s3.source_size > 0 THEN s3.target / s3.source_size ELSE 0.0 END AS e,
       CAST(CAST('0x' || substr(md5('mix' || CASE WHEN d.source IS NULL THEN '-' ELSE '+' || d.source END), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296 AS u,
       row_number() OVER (PARTITION BY d.source ORDER BY d.size, md5('mix' || CAST(d.doc_id AS VARCHAR)) NULLS LAST, d.doc_id NULLS LAST) AS r
       FROM sized d JOIN s3 ON d.source IS NOT DISTINCT FROM s3.source),
taken AS (SELECT *, CAST(floor(u + e * r) - floor(u + e * (r - 1)) AS BIGINT) AS copies FROM placed)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM taken
"""
