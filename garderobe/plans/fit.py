"""Fit reports for outside products: hem on the user, size verdict, catalog match and a small rack of similar items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garderobe.functions import hem as H
from garderobe.functions.markup import canonical_url
from garderobe.functions.sizes import size_verdict
from garderobe.operators.filters import usd_price
from garderobe.operators.joins import already_listed
from garderobe.operators.neighbours import dense_top_k
from garderobe.session import stage

SIMILAR = 8


def fit_rows(products: DataFrame, users: DataFrame, catalog: DataFrame) -> DataFrame:
    """(check_id, user_id) rows with hem, size verdict and catalog match.

    ``products`` has (check_id, user_id, url, size_labels, availability, length_inches, length_class, length_basis).
    """
    asked = products.withColumn("url", canonical_url(F.col("url")))
    known = catalog.select("listing_id", canonical_url(F.col("source_url")).alias("source_url"))
    rows = already_listed(asked, known).join(users.select("user_id", "height_inches", "heel_inches", "sizes"), "user_id")
    return rows.select(
        "check_id", "user_id", "url", "in_catalog", "found_id",
        H.hem(F.col("length_inches"), F.col("length_class"), F.col("height_inches"), F.col("heel_inches"), F.col("length_basis")).alias("hem"),
        size_verdict(F.col("sizes"), F.col("size_labels"), F.col("availability")).alias("size_match"))


def similar_rack(products: DataFrame, users: DataFrame, pool: DataFrame, vectors: DataFrame, k: int = SIMILAR) -> DataFrame:
    """The ``k`` visually closest listings per check (check_id, user_id, vector) among all in the user's sizes and budget, or the closest
    as they are where none fits. Prices compare in US cents. The limits are asked while neighbours are searched, so a listing that fits is
    found however many closer ones do not."""
    facts = vectors.join(pool.select("listing_id", F.col("size_normalized").alias("have"), usd_price().cast("double").alias("price")), "listing_id")
    offered = facts.select(F.col("listing_id").alias("id"), "vector", F.coalesce("have", F.array().cast("array<int>")).alias("have"), "price")
    wants = users.select("user_id", F.coalesce(F.col("sizes").cast("array<int>"), F.array().cast("array<int>")).alias("want"), F.col("budget_max_cents").cast("double").alias("most"))
    asked = stage(products.join(wants, "user_id").select(F.col("check_id").alias("qid"), "vector", "want", "most"), "fit-checks")
    fitting = stage(dense_top_k(asked, offered, k, limits=True), "fit-rack")
    rest = dense_top_k(asked.join(fitting.select("qid").distinct(), "qid", "left_anti").select("qid", "vector"), offered.select("id", "vector"), k)
    rows = fitting.withColumn("fits", F.lit(True)).unionByName(rest.withColumn("fits", F.lit(False)))
    score = ((F.col("score") + 1) / 2).alias("score")
    return rows.select(F.col("qid").alias("check_id"), F.col("id").alias("listing_id"), score, "rank", "fits", F.lit("embedding").alias("basis"))
