"""Row-count comparison of two sets of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE = 0.02
SLACK_ROWS = 5


def count_table(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n) for named frames, one count each, as one plan."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def reconcile(live: DataFrame, restored: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Per live table: both counts (-1 when missing) and whether they differ by no more than the tolerance."""
    rows = live.select("table", F.col("n").alias("live")).join(
        restored.select("table", F.col("n").alias("restored")), "table", "left")
    allowed = F.greatest(F.ceil(F.col("live") * tolerance), F.lit(SLACK_ROWS))
    ok = F.coalesce(F.abs(F.col("restored") - F.col("live")) <= allowed, F.lit(False))
    return rows.select("table", "live", F.coalesce("restored", F.lit(-1)).alias("restored"), ok.alias("ok"))
