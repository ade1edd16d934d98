"""Exact top-k by cosine between sparse weight maps, over blocks of inverted lists with an upper bound for every list."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garderobe.operators.ranking import top_n
from garderobe.session import stage

SCORE_DIGITS = 9
SLACK = 1e-7  # float slack of the bounds
BLOCK_ROWS = 4096  # maps of one block of the index, and queries that meet it at once
SEQUENCE_BITS = 33  # monotonically_increasing_id keeps the place within a partition in so many low bits


def unit_map(weights: Column) -> Column:
    """The map divided by its length; NULL if it is empty, NULL or all zero. Zero and NULL weights are left out."""
    kept = F.map_filter(weights, lambda _, w: F.coalesce(w, F.lit(0.0)) != 0)
    length = F.sqrt(F.aggregate(F.map_values(kept), F.lit(0.0), lambda s, w: s + w * w))
    return F.when(length > 0, F.transform_values(kept, lambda _, w: w / length))


def _numbered(df: DataFrame, key: str, block_rows: int, label: str) -> DataFrame:
    """Rows with usable maps, written once with numbers ``n`` that ascend with ``key``, in blocks of neighbours. Equal beginnings of keys
    fall into one block, so keys made of tags bring like maps together."""
    unit = df.withColumn("tags", unit_map(F.col("tags"))).filter("tags is not null").orderBy(key).withColumn("n", F.monotonically_increasing_id())
    part, place = F.shiftright("n", SEQUENCE_BITS), F.col("n").bitwiseAND((1 << SEQUENCE_BITS) - 1)
    return stage(unit.withColumn("block", F.shiftleft(part, 24) + F.floor(place / block_rows)), label)


def _best_of_block(k: int):
    """Top-k of each query of a chunk in one block, by the block's inverted lists."""

    def search(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or block.empty:
            return pd.DataFrame({"q": [], "c": [], "score": [], "tie": []})
        block = block.sort_values(["tie", "n"], ascending=[False, True], kind="stable")
        lists = defaultdict(lambda: ([], []))
        for place, (tags, weights) in enumerate(zip(block["keys"], block["weights"], strict=True)):
            for tag, u in zip(tags, weights, strict=True):
                lists[tag][0].append(place)
                lists[tag][1].append(u)
        lists = {tag: (np.array(places), np.array(us)) for tag, (places, us) in lists.items()}
        numbers, ties, found = block["n"].to_numpy(), block["tie"].to_numpy(), []
        for q, tags, weights in zip(queries["q"], queries["keys"], queries["weights"], strict=True):
            total = np.zeros(len(block))
            for tag, v in zip(tags, weights, strict=True):
                if tag in lists:
                    places, us = lists[tag]
                    total[places] += v * us
            total = total.round(SCORE_DIGITS)
            able = np.flatnonzero(total > 0)
            if len(able) > k:  # ties at the k-th score stay until they are ordered
                able = able[total[able] >= np.partition(total[able], -k)[-k]]
            able = able[np.argsort(-total[able], kind="stable")[:k]]
            found.append(pd.DataFrame({"q": q, "c": numbers[able], "score": total[able], "tie": ties[able]}))
        return pd.concat(found, ignore_index=True)

    return search


def sparse_top_k(queries: DataFrame, catalog: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``k`` nearest catalog maps with a cosine above 0 of every query: (qid, id, score, tie, rank).

    ``queries`` has (qid, tags), ``catalog`` (id, tags, tie); ids are unique, larger ``tie`` first among equal scores, then smaller id. Empty,
    NULL and all-zero maps are near nothing.

    The catalog is cut into blocks of inverted lists (tag -> maps with their weights), each list with its highest and lowest weight. What a
    query's tags can gain at most from a block's lists bounds its scores there. Every query is first searched in the block with the
    highest bound; the k-th score there is a floor, and the other blocks are visited only where their bound reaches it. A tag that most
    maps share is a list in each of many blocks; the number of distinct tags does not matter, and no map is made dense.
    """
    asked = _numbered(queries.select("qid", "tags"), "qid", block_rows, "sparse-queries")
    maps = _numbered(catalog.select("id", "tags", F.col("tie").cast("long").alias("tie")), "id", block_rows, "sparse-catalog")
    lists = stage(maps.select("block", F.explode("tags").alias("tag", "u")).groupBy("block", "tag").agg(F.max("u").alias("hi"), F.min("u").alias("lo")), "sparse-lists")
    gain = F.greatest(F.col("v") * F.col("hi"), F.col("v") * F.col("lo"), F.lit(0.0))
    entries = asked.select(F.col("n").alias("q"), F.col("block").alias("chunk"), F.explode("tags").alias("tag", "v"))
    bounds = stage(entries.join(lists, "tag").groupBy("q", "chunk", "block").agg(F.least(F.sum(gain), F.lit(1.0)).alias("bound")).filter("bound > 0"), "sparse-bounds")
    arrays = [F.map_keys("tags").alias("keys"), F.map_values("tags").alias("weights")]

    def searched(visits: DataFrame) -> DataFrame:
        pairs = visits.select("q", "chunk", "block")
        left = pairs.join(asked.select(F.col("n").alias("q"), *arrays), "q")
        right = maps.select("block", "n", "tie", *arrays).join(pairs.select("chunk", "block").distinct(), "block").withColumnsRenamed({"chunk": "c_chunk", "block": "c_block"})
        return left.groupBy("block", "chunk").cogroup(right.groupBy("c_block", "c_chunk")).applyInPandas(_best_of_block(k), "q long, c long, score double, tie long")

    order = [F.desc("score"), F.desc("tie"), F.asc("c")]
    leading = top_n(bounds, ["q"], [F.desc("bound"), F.asc("block")], 1, "_first").drop("_first")
    first = stage(searched(leading), "sparse-first")
    floors = first.groupBy("q").agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("kth")).filter(F.col("found") >= k)
    others = bounds.join(leading.select("q", "block"), ["q", "block"], "left_anti").join(floors, "q", "left").filter(F.col("kth").isNull() | (F.col("bound") >= F.col("kth") - SLACK))
    best = top_n(first.unionByName(searched(others)), ["q"], order, k)
    named = best.join(asked.select(F.col("n").alias("q"), "qid"), "q").join(maps.select(F.col("n").alias("c"), "id"), "c")
    return named.select("qid", "id", "score", "tie", "rank")
