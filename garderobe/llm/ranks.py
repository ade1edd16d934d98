"""Ranks within groups of any size, without putting a group into one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garderobe.session import stage

SEQUENCE_BITS = 33  # monotonically_increasing_id keeps the place within a partition in so many low bits


def ranked(df: DataFrame, keys: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """Adds each row's place (from 1) among the rows with equal ``keys``, nulls being equal, by ``order``.

    Rows are range-partitioned by keys and order, sorted and written once with their place in the partition. What lies before a
    partition is summed from one count per partition and key, so a key with a third of all rows spans as many tasks as it needs.
    Rows that tie in ``order`` take neighbouring places in any order.
    """
    by = [F.col(k).asc_nulls_last() for k in keys] + order
    placed = stage(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_ranks_place", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumn("_ranks_part", F.shiftright("_ranks_place", SEQUENCE_BITS))
    runs = placed.groupBy("_ranks_part", *keys).agg(F.count(F.lit(1)).alias("_ranks_rows"), F.min("_ranks_place").alias("_ranks_first"))
    earlier = Window.partitionBy(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], *[F.col(k).isNull() for k in keys]).orderBy("_ranks_part")
    before = F.coalesce(F.sum("_ranks_rows").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = stage(runs.withColumn("_ranks_before", before).select(F.col("_ranks_part").alias("_ranks_run"), *[F.col(k).alias(f"_ranks_key_{k}") for k in keys], "_ranks_first", "_ranks_before"), "runs")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_ranks_key_{k}")) for k in keys], F.col("_ranks_part") == F.col("_ranks_run"))
    return placed.join(runs, same).withColumn(rank, F.col("_ranks_before") + F.col("_ranks_place") - F.col("_ranks_first") + 1).drop("_ranks_place", "_ranks_part", "_ranks_first", "_ranks_before", *runs.columns)
