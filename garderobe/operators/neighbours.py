"""Exact top-k by cosine for many queries, block by block and with pruned blocks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from garderobe.operators.ranking import top_n
from garderobe.session import stage

BLOCK_ROWS = 4096
LOT_BLOCKS = 4  # a lot is about so many blocks of rows; it meets as many queries at once
TILE = 1024  # queries that are scored against a block at a time
MAX_PIVOTS = 128
SCORE_DIGITS = 9
SLACK = 1e-7  # float slack of the angle bound


def _unit(column: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in column])
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _pivot_matrix(catalog: DataFrame, n: int) -> np.ndarray:
    """A bounded, repeatable sample of catalog vectors (never more than MAX_PIVOTS rows reach the driver)."""
    rows = catalog.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(min(n, MAX_PIVOTS)).toPandas()
    return _unit(rows["vector"])


def _with_cell(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds the nearest pivot (``cell``) and the angle to it."""
    def assign(batches):
        for pdf in batches:
            if len(pdf):
                cos = np.clip(_unit(pdf["vector"]) @ pivots.T, -1.0, 1.0)
                cell = cos.argmax(axis=1)
                yield pdf.assign(cell=cell.astype("int32"), angle=np.arccos(cos[np.arange(len(cos)), cell]))

    return df.mapInPandas(assign, df.schema.simpleString()[7:-1] + ", cell int, angle double")


LIMITS_Q, LIMITS_C = ["want", "most"], ["have", "price"]


def _prices(column: pd.Series) -> np.ndarray:
    return column.to_numpy(dtype=np.float64, na_value=np.inf)


def _labels(queries: pd.DataFrame, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Wanted and offered labels as rows of zeros and ones; a query without wanted labels takes any."""
    labels = {label: i for i, label in enumerate(sorted({x for want in queries["want"] for x in want}))}
    wanted, offered = np.zeros((len(queries), len(labels) + 1), np.float32), np.zeros((len(rows), len(labels) + 1), np.float32)
    for side, column in ((wanted, queries["want"]), (offered, rows["have"])):
        for row, own in enumerate(column):
            side[row, [labels[x] for x in own if x in labels]] = 1
    offered[:, -1], wanted[:, -1] = 1, wanted.sum(axis=1) == 0
    return wanted, offered


def _local_top(pivots: np.ndarray, k: int, drop_self: bool, limits: bool):
    """Top-k of a chunk of queries against the blocks of a lot.

    A query meets a block only if its angle to the block's pivot allows a score above the query's ``floor``, and of a block only rows
    that reach the floor are looked at; where many do, the block's best k are, and the worst of them becomes the floor.
    """
    columns = ["qid", "id", "score", "tie", "times"]

    def search(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or rows.empty:
            return pd.DataFrame(columns=columns, dtype=object)
        rows = rows.sort_values(["tie", "id"], ascending=[False, True], kind="stable", ignore_index=True)
        asked, held = _unit(queries["vector"]), _unit(rows["vector"])
        floor, angles = queries["floor"].to_numpy(dtype=np.float64).copy(), np.arccos(np.clip(asked @ pivots.T, -1.0, 1.0))
        if drop_self:
            same = pd.factorize(pd.concat([queries["qid"], rows["id"]], ignore_index=True))[0]
            own, other = same[: len(queries)], same[len(queries) :]
        if limits:
            (wanted, offered), most, price = _labels(queries, rows), _prices(queries["most"]), _prices(rows["price"])
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for (cell, _), at in rows.groupby(["cell", "sub"], sort=False).indices.items():
            radius = rows["angle"].to_numpy()[at].max()
            near = np.flatnonzero(~(angles[:, cell] - radius > np.arccos(np.clip(floor, -1.0, 1.0)) + SLACK))
            for part in (near[i : i + TILE] for i in range(0, len(near), TILE)):
                scores = asked[part] @ held[at].T
                if drop_self:
                    scores[own[part][:, None] == other[at][None, :]] = -np.inf
                if limits:
                    scores[~((wanted[part] @ offered[at].T > 0) & (price[at][None, :] <= most[part][:, None]))] = -np.inf
                reach = (scores >= floor[part][:, None] - SLACK) & np.isfinite(scores)
                many = reach.sum(axis=1) > 4 * k
                q, c = np.nonzero(reach & ~many[:, None])
                found.append((part[q], at[c], np.round(scores[q, c], SCORE_DIGITS)))
                if many.any():
                    rounded = np.round(scores[many], SCORE_DIGITS)
                    best = np.argsort(-rounded, axis=1, kind="stable")[:, :k]
                    values, q = np.take_along_axis(rounded, best, axis=1), part[many]
                    found.append((np.repeat(q, best.shape[1]), at[best.ravel()], values.ravel()))
                    floor[q] = np.maximum(floor[q], values[:, -1])
        if not sum(len(q) for q, _, _ in found):
            return pd.DataFrame(columns=columns, dtype=object)
        q, c, score = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((c, -score, q))
        q, c, score = q[order], c[order], score[order]
        first = np.arange(len(q)) - np.searchsorted(q, q) < k
        q, c, score = q[first], c[first], score[first]
        return pd.DataFrame({"qid": queries["qid"].to_numpy()[q], "id": rows["id"].to_numpy()[c], "score": score, "tie": rows["tie"].to_numpy()[c], "times": queries["times"].to_numpy()[q]}, columns=columns)

    return search


def _search(asked: DataFrame, rows: DataFrame, key: list[str], pivots: np.ndarray, k: int, drop_self: bool, limits: bool) -> DataFrame:
    """The best k rows for each query of a group of ``asked`` among the rows of the same group: (qid, id, score, tie), ``times`` of each."""
    schema = f"qid {asked.schema['qid'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, score double, tie long, times int"
    own = {c: f"_{c}" for c in key}
    grouped = rows.select("*", *(F.col(c).alias(n) for c, n in own.items())).groupBy(*own.values())
    found = asked.groupBy(*key).cogroup(grouped).applyInPandas(_local_top(pivots, k, drop_self, limits), schema)
    return found.withColumn("_again", F.explode(F.sequence(F.lit(1), "times"))).drop("_again", "times")


def dense_top_k(queries: DataFrame, catalog: DataFrame, k: int, drop_self: bool = False,
                block_rows: int = BLOCK_ROWS, limits: bool = False) -> DataFrame:
    """Exact k nearest catalog vectors per query by cosine: (qid, id, score, rank).

    ``queries`` has (qid, vector), ``catalog`` (id, vector) and optionally ``tie`` (larger first among equal scores;
    then smaller id). Vectors are filed under their nearest pivot and cut into blocks of about ``block_rows``, so a cell
    holding most vectors becomes many blocks. A first search of one block near each query gives a score that k rows are
    known to reach; afterwards a block is visited only if the angle between query and pivot, less the block's own radius,
    still allows a better score, and only rows that reach the known score are shuffled on, k of a lot at most.

    Blocks travel in lots of ``LOT_BLOCKS`` blocks' rows, queries in chunks of as many: a vector is sent once to each lot or chunk that it
    meets, not to each block, so what is moved is the product of both sides divided by the size of a lot. Tasks hold a lot and a chunk.

    With ``limits`` a query has (want array, most) and a catalog row (have array, price) besides: only rows with a label in common and a price
    within the limit count among the k. Blocks hold rows of one price band, and a lot whose lowest price rules all its rows out is not visited.

    Rows without a ``qid`` ask nothing; a ``qid`` that stands on several rows has its rows ranked together.
    """
    more_q, more_c = (LIMITS_Q, LIMITS_C) if limits else ([], [])
    if "tie" not in catalog.columns:
        catalog = catalog.withColumn("tie", F.lit(0).cast("long"))
    catalog = catalog.select("id", "vector", F.col("tie").cast("long").alias("tie"), *more_c)
    spark, n_rows = catalog.sparkSession, catalog.count()
    nothing = spark.createDataFrame([], f"qid {queries.schema['qid'].dataType.simpleString()}, id {catalog.schema['id'].dataType.simpleString()}, score double, rank int")
    if n_rows == 0:
        return nothing
    pivots = _pivot_matrix(catalog, max(1, math.ceil(math.sqrt(n_rows / 16))))
    asked = stage(_with_cell(queries.filter(F.col("qid").isNotNull()).select("qid", "vector", *more_q), pivots).drop("angle"), "asked")
    n_queries = asked.count()
    if n_queries == 0:
        return nothing
    cells = stage(_with_cell(catalog, pivots), "cells")
    if limits:  # bands of prices by powers of two, each cut into blocks of its own
        cells = cells.withColumn("band", F.coalesce(F.floor(F.log2(F.greatest(F.col("price"), F.lit(1.0)))), F.lit(64)).cast("int"))
    banded = ["cell", "band"] if limits else ["cell"]
    sizes = cells.groupBy(*banded).agg(F.count(F.lit(1)).alias("n"))
    subs = F.ceil(F.col("n") / block_rows).cast("int")
    blocks = (
        cells.join(sizes, banded)
        .withColumn("sub", (F.pmod(F.xxhash64("id"), subs) + (F.shiftleft("band", 24) if limits else 0)).cast("int"))
        .select("cell", "sub", "id", "vector", "tie", "angle", *more_c)
    )
    of_limits = [F.min("price").alias("lowest"), F.array_distinct(F.flatten(F.collect_set("have"))).alias("labels")] if limits else []  # a block is bounded
    before = Window.orderBy(F.shiftright("sub", 24), "cell", "sub").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    shape = blocks.groupBy("cell", "sub").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n"), *of_limits)
    shape = stage(shape.withColumn("lot", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / (LOT_BLOCKS * block_rows)).cast("int")), "blocks")
    chunks = max(math.ceil(n_queries / (LOT_BLOCKS * block_rows)), min(spark.sparkContext.defaultParallelism, math.ceil(n_queries / block_rows)))

    # A qid on m rows met its pairs m times and its limits m times more; its rows count as often.
    times = F.least(F.pow("_m", F.lit(len(more_q) // 2 + 1)), F.lit(k)).cast("int")
    repeated = asked.groupBy("qid").agg(F.count(F.lit(1)).alias("_m")).filter("_m > 1").select("qid", times.alias("times"))
    open_block = lambda b: F.lit(True)
    if limits:
        open_block = lambda b: ((F.size("want") == 0) | F.arrays_overlap("want", b["labels"])) & (F.col("most").isNull() | F.coalesce(b["lowest"] <= F.col("most"), F.lit(False)))
    by_cell = shape.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("sub", *(["lowest", "labels"] if limits else [])))).alias("_blocks"))
    near = asked.join(F.broadcast(by_cell), "cell").withColumn("_open", F.filter("_blocks", open_block)).filter(F.size("_open") > 0)
    near = near.withColumn("sub", F.get("_open", F.lit(0) if limits else F.pmod(F.xxhash64("qid"), F.size("_open")).cast("int"))["sub"]).drop("_blocks", "_open")
    parts = near.groupBy("cell", "sub").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_parts"))
    near = near.join(F.broadcast(parts), ["cell", "sub"]).withColumn("part", F.pmod(F.xxhash64("qid"), "_parts").cast("int")).drop("_parts").withColumns(
        {"floor": F.lit(-math.inf), "times": F.lit(1)})
    nearby = blocks.join(F.broadcast(parts), ["cell", "sub"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    first = top_n(_search(near, nearby, ["cell", "sub", "part"], pivots, k, drop_self, limits), ["qid"],
                  [F.desc("score"), F.desc("tie"), F.asc("id")], k)
    reached = first.groupBy("qid").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("found"))
    floor = asked.drop("cell").join(reached, "qid", "left").join(repeated, "qid", "left").select(
        "qid", "vector", *more_q, F.when(F.col("found") >= k, F.col("kth")).otherwise(-math.inf).alias("floor"), F.coalesce("times", F.lit(1)).alias("times"),
        F.pmod(F.xxhash64("qid"), F.lit(chunks)).cast("int").alias("chunk"))

    # By lot the farthest row of each of its cells, and its lowest price: one row a cell and lot reaches the driver.
    lots: dict[int, tuple[list[int], list[float]]] = {}
    lowest: dict[int, float] = {}
    for row in shape.groupBy("lot", "cell").agg(F.max("radius").alias("radius"), *([F.min("lowest").alias("lowest")] if limits else [])).collect():
        own = lots.setdefault(row["lot"], ([], []))
        own[0].append(row["cell"])
        own[1].append(row["radius"])
        if limits:
            lowest[row["lot"]] = min(lowest.get(row["lot"], math.inf), math.inf if row["lowest"] is None else row["lowest"])

    def visit(batches):
        for pdf in batches:
            if len(pdf):
                angles = np.arccos(np.clip(_unit(pdf["vector"]) @ pivots.T, -1.0, 1.0))
                limit = np.arccos(np.clip(pdf["floor"].to_numpy(), -1.0, 1.0)) + SLACK
                for lot, (own, radius) in lots.items():
                    open_ = (~(angles[:, own] - np.array(radius) > limit[:, None])).any(axis=1)
                    if limits:
                        open_ &= lowest[lot] <= _prices(pdf["most"])
                    if open_.any():
                        yield pd.DataFrame({c: pdf[c].to_numpy()[open_] for c in pdf.columns}).assign(lot=np.int32(lot))

    visits = floor.mapInPandas(visit, floor.schema.simpleString()[7:-1] + ", lot int")
    carried = blocks.join(F.broadcast(shape.select("cell", "sub", "lot")), ["cell", "sub"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    found = _search(visits, carried, ["chunk", "lot"], pivots, k, drop_self, limits)
    return top_n(found, ["qid"], [F.desc("score"), F.desc("tie"), F.asc("id")], k).select("qid", "id", "score", "rank")
