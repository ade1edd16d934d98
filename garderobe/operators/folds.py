"""Order-sensitive folds over event histories, and vector sums, without gathering a key's history in one task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garderobe.functions.vectors import l2_normalize


def _fold_runs(deltas: np.ndarray, starts: np.ndarray, lengths: np.ndarray, low: float, high: float):
    """Each run of steps x -> clamp(x + d) as one step x -> min(top, max(bottom, x + shift))."""
    shift = np.add.reduceat(deltas, starts) if len(starts) else np.empty(0)
    bottom = np.full(len(starts), -np.inf)
    top = np.full(len(starts), np.inf)
    for at in range(int(lengths.max()) if len(lengths) else 0):
        live = np.flatnonzero(lengths > at)
        d = deltas[starts[live] + at]
        bottom[live] = np.clip(bottom[live] + d, low, high)
        top[live] = np.clip(top[live] + d, low, high)
    return shift, bottom, top


def clamped_fold(steps: DataFrame, keys: list[str], order: list[str], delta: str, low: float, high: float,
                 start: DataFrame | None = None) -> DataFrame:
    """Fold ``value = clamp(value + delta, low, high)`` over each key's steps in order: (keys..., value).

    A run of clamped steps is again one clamped step, and such steps compose, so the history may be cut anywhere. Rows are
    range-partitioned by (keys, order): a key with a third of all rows spans many partitions. Each partition reduces
    every key it holds to one step; the few steps per key are then composed in partition order.
    ``start`` holds (keys..., value) to begin from; other keys begin at 0.
    """
    rows = steps.select(*keys, *order, F.col(delta).cast("double").alias("_d"))
    ranged = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).select(*keys, "_d")
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    schema += ", _part int, _shift double, _bottom double, _top double"

    def reduce(batches):
        part = TaskContext.get().partitionId()
        held = None  # the run that may go on in the next batch

        def emit(frame: pd.DataFrame) -> pd.DataFrame:
            return frame.assign(_part=np.int32(part))

        for pdf in batches:
            if not len(pdf):
                continue
            changed = np.zeros(len(pdf), dtype=bool)
            changed[0] = True
            for k in keys:
                col = pdf[k].to_numpy()
                changed[1:] |= col[1:] != col[:-1]
            starts = np.flatnonzero(changed)
            lengths = np.diff(np.append(starts, len(pdf)))
            shift, bottom, top = _fold_runs(pdf["_d"].to_numpy(), starts, lengths, low, high)
            out = pdf.iloc[starts][keys].reset_index(drop=True)
            out["_shift"], out["_bottom"], out["_top"] = shift, bottom, top
            if held is not None:
                if all(held[k] == out.at[0, k] for k in keys):
                    lo, hi, d = out.at[0, "_bottom"], out.at[0, "_top"], out.at[0, "_shift"]
                    out.at[0, "_bottom"] = min(hi, max(lo, held["_bottom"] + d))
                    out.at[0, "_top"] = min(hi, max(lo, held["_top"] + d))
                    out.at[0, "_shift"] = held["_shift"] + d
                else:
                    yield emit(pd.DataFrame([held]))
            held = out.iloc[-1].to_dict()
            if len(out) > 1:
                yield emit(out.iloc[:-1])
        if held is not None:
            yield emit(pd.DataFrame([held]))

    parts = ranged.mapInPandas(reduce, schema).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_part", "_shift", "_bottom", "_top"))).alias("_steps")
    )
    if start is not None:
        parts = parts.join(start.select(*keys, F.col("value").alias("_start")), keys, "full_outer")
    else:
        parts = parts.withColumn("_start", F.lit(0.0))
    value = F.aggregate(
        F.coalesce("_steps", F.array().cast(parts.schema["_steps"].dataType)), F.coalesce("_start", F.lit(0.0)),
        lambda x, s: F.least(s["_top"], F.greatest(s["_bottom"], x + s["_shift"])),
    )
    return parts.select(*keys, value.alias("value"))


HELD_KEYS = 4096  # keys whose sums a task holds before it passes them on


def weighted_vector_sum(rows: DataFrame, keys: list[str], vector: str, weight: Column) -> DataFrame:
    """(keys..., vector, weight): sum of weight * vector per key.

    Tasks add up whole vectors of the keys they meet; of a key, a few sums a task are shuffled, however many rows it has.
    """
    cells = rows.select(*keys, weight.cast("double").alias("weight"), F.col(vector).cast("array<double>").alias("vector"))
    key_types = {k: cells.schema[k].dataType.simpleString() for k in keys}
    schema = ", ".join(f"`{k}` {t}" for k, t in key_types.items()) + ", vector array<double>, weight double"

    def added(frames) -> pd.DataFrame:
        frame = pd.concat(frames, ignore_index=True)
        groups = frame.groupby(keys, sort=False, dropna=False)
        place, first = groups.ngroup().to_numpy(), ~frame.duplicated(keys).to_numpy()
        sums = np.zeros((int(place.max()) + 1, max(map(len, frame["vector"]))))
        for width in {len(v) for v in frame["vector"]}:
            own = np.flatnonzero([len(v) == width for v in frame["vector"]])
            np.add.at(sums[:, :width], place[own], np.stack(frame["vector"].iloc[own].to_list()))
        return frame.loc[first, keys].assign(vector=list(sums), weight=np.bincount(place, frame["weight"]))

    def partial(batches):
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if len(pdf):
                held = [added([*held, pdf.assign(vector=[w * np.asarray(v) for w, v in zip(pdf["weight"], pdf["vector"], strict=True)])])]
                if len(held[0]) > HELD_KEYS:
                    yield held.pop()
        yield from held

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        return added([pdf])

    return cells.filter(F.col("vector").isNotNull()).mapInPandas(partial, schema).groupBy(*keys).applyInPandas(merged, schema).select(*keys, "vector", "weight")


def mean_vector(rows: DataFrame, keys: list[str], vector: str, weight: Column) -> DataFrame:
    """Weighted mean, scaled to unit length; keys whose mean is the zero vector or has no weight drop out."""
    usable = rows.filter((F.size(vector) > 0) & (weight > 0))
    total = weighted_vector_sum(usable, keys, vector, weight)
    mean = F.transform("vector", lambda x: x / F.col("weight"))
    return (
        total.filter(F.col("weight") > 0)
        .select(*keys, l2_normalize(mean).alias("vector"))
        .filter(F.exists("vector", lambda x: x != 0))
    )
