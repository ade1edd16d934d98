"""Connected components of an edge table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garderobe.session import stage


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _stars(edges: DataFrame, label: str) -> DataFrame:
    """Edges (u, v) with v and the least of u's neighbours and u itself. The least are written first, so a hub's rows can be split."""
    least = stage(edges.groupBy(F.col("u").alias("_hub")).agg(F.least(F.min("v"), F.min("u")).alias("_least")), label)
    return edges.join(least, F.col("u") == F.col("_hub")).select("u", "v", "_least")


def connected(edges: DataFrame) -> DataFrame:
    """(u, v) long -> (node, component): every node of an edge and the least node it is connected with.

    Large and small stars in turn: each round hangs neighbours on the least node known, first the larger ones, then the others, until
    nothing changes. A round moves each edge a few times; no node's neighbours are gathered. Loops and repeated edges do no harm.
    """
    edges = stage(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v").distinct(), "edges")
    mark = None
    while True:
        large = _stars(_both_ways(edges), "hubs").filter("v > u").select(F.col("v").alias("u"), F.col("_least").alias("v")).filter("u <> v").distinct()
        down = stage(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "large")
        small = _stars(down, "hubs")
        hung = small.select(F.col("v").alias("u"), F.col("_least").alias("v")).unionByName(small.select("u", F.col("_least").alias("v")))
        edges = stage(hung.filter("u <> v").distinct(), "edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == mark:
            break
        mark = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
