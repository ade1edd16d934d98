"""Shards of nearly equal bytes whose groups of equal texts stay together, by differencing.

Differencing (Karmarkar and Karp) starts with one partial partition for each group: the group in one slot, nothing in the others. Again and
again the two partial partitions with the largest spread are combined, the fullest slots of one with the emptiest of the other, until one
partition is left.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from garderobe.llm.ranks import ranked
from garderobe.session import stage

SHARDS = 16
HEAVY = 1024  # a group with at least this fraction of all bytes is placed on the driver: there are so many at most
TASK_GROUPS = 100_000  # about so many other groups are differenced in one task
NONE = -1
PLACED = "group_key binary, task int, slot int, weight long"


def combined(partials: Sequence[tuple[Sequence[int], Sequence[int]]], slots: int) -> tuple[list[int], list[list[int]]]:
    """One partition from partial ones: (sums of its slots ascending, members of each slot).

    A partial partition is (sums, members) by slot; a member is a number or ``NONE``. Slots of equal sums are ordered by member, partial
    partitions of equal spread by their place, so the same input gives the same partition.
    """
    up: dict[int, int] = {}
    fresh = 1 + max((m for _, members in partials for m in members), default=NONE)
    first_fresh, heap = fresh, []
    for k, (sums, members) in enumerate(partials):
        ordered = sorted(zip(sums, members, strict=True))
        heap.append((ordered[0][0] - ordered[-1][0], k, ordered))
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        one, other = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        joined = []
        for (a, x), (b, y) in zip(one, reversed(other), strict=True):
            if x == NONE or y == NONE:
                joined.append((a + b, max(x, y)))
            else:
                up[x] = up[y] = fresh
                joined.append((a + b, fresh))
                fresh += 1
        joined.sort()
        heapq.heappush(heap, (joined[0][0] - joined[-1][0], serial, joined))
        serial += 1
    last = heap[0][2] if heap else [(0, NONE)] * slots
    slot_of = {m: s for s, (_, m) in enumerate(last) if m != NONE}
    slots_of: list[list[int]] = [[] for _ in range(slots)]
    for m in range(fresh - 1, -1, -1):  # a joined member is newer than what it joins
        if m in up:
            slot_of[m] = slot_of[up[m]]
        if m in slot_of and m < first_fresh:
            slots_of[slot_of[m]].append(m)
    return [s for s, _ in last], slots_of


def partition(weights: Sequence[int], slots: int, start: Sequence[int] | None = None) -> tuple[list[int], list[int]]:
    """The slot of every weight and the sums of the slots. With ``start`` the slots already hold so much and keep their numbers."""
    partials = [([0] * (slots - 1) + [int(w)], [NONE] * (slots - 1) + [i]) for i, w in enumerate(weights)]
    if start is not None:
        partials.insert(0, (list(start), [len(weights) + s for s in range(slots)]))
    sums, members = combined(partials, slots)
    number = list(range(slots))
    if start is not None:
        number = [next(m for m in own if m >= len(weights)) - len(weights) for own in members]
    slot, total = [0] * len(weights), [0] * slots
    for s, own in enumerate(members):
        total[number[s]] = sums[s]
        for m in own:
            if m < len(weights):
                slot[m] = number[s]
    return slot, total


def interchanged(loads: dict[int, list[int]], held: Sequence[int]) -> dict[int, list[int]]:
    """task -> the shard of each of its slots. Slots whose shards hold equally much of the heavy groups may change places; the tasks'
    partial partitions are combined by differencing within those."""
    slots = len(held)
    target = {task: list(range(slots)) for task in loads}
    for amount in set(held):
        alike = [s for s in range(slots) if held[s] == amount]
        if len(alike) > 1 and loads:
            tasks = sorted(loads)
            partials = [([loads[t][s] for s in alike], [i * len(alike) + k for k in range(len(alike))]) for i, t in enumerate(tasks)]
            for place, own in enumerate(combined(partials, len(alike))[1]):
                for m in own:
                    target[tasks[m // len(alike)]][alike[m % len(alike)]] = alike[place]
    return target


def text_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def group_shards(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(group_key, weight) -> (group_key, shard) with nearly equal sums of weights.

    Groups with 1/``HEAVY`` of the whole or more are differenced on the driver. The others are dealt out by key; every task differences its
    own, beginning with the partial partition of the heavy groups at the task's share of the bytes, so that it leaves room beside
    them. The tasks' sums, one row a task and slot, are combined by differencing again where shards are alike. A group that outweighs
    a fair shard has one for itself.
    """
    spark = groups.sparkSession
    total = groups.agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("n")).first()
    whole = total["total"] or 0
    is_heavy = F.col("weight") * HEAVY >= whole
    heavy = sorted(map(tuple, groups.filter(is_heavy).select("weight", "group_key").collect()), key=lambda r: (-r[0], r[1]))  # HEAVY rows at most
    heavy_slots, held = partition([w for w, _ in heavy], shards)
    on_driver = spark.createDataFrame([(bytes(key), slot) for (_, key), slot in zip(heavy, heavy_slots, strict=True)], "group_key binary, shard int")
    light_n, light_whole = total["n"] - len(heavy), whole - sum(w for w, _ in heavy)
    if not light_n:
        return on_driver

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("group_key"), b.column("weight").to_numpy()) for b in batches if b.num_rows]
        if not parts:
            return
        keys = pa.chunked_array([k for k, _ in parts]).combine_chunks()
        weights = np.concatenate([w for _, w in parts])
        share = int(weights.sum())
        slots, _ = partition(weights.tolist(), shards, [h * share // light_whole for h in held])
        yield pa.RecordBatch.from_arrays([keys, pa.array([TaskContext.get().partitionId()] * len(weights), pa.int32()), pa.array(slots, pa.int32()), pa.array(weights, pa.int64())], ["group_key", "task", "slot", "weight"])

    dealt = groups.filter(~is_heavy).select("group_key", "weight").repartition(max(1, -(-light_n // TASK_GROUPS)), "group_key")
    placed = stage(dealt.sortWithinPartitions(F.desc("weight"), "group_key").mapInArrow(rows, PLACED), "placed")
    loads: dict[int, list[int]] = {}
    for row in placed.groupBy("task", "slot").agg(F.sum("weight").alias("load")).collect():  # one row a task and slot
        loads.setdefault(row["task"], [0] * shards)[row["slot"]] = row["load"]
    moved = spark.createDataFrame([(t, s, to) for t, target in interchanged(loads, held).items() for s, to in enumerate(target)], "task int, slot int, shard int")
    return placed.join(moved, ["task", "slot"]).select("group_key", "shard").unionByName(on_driver)


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row: equal texts share a shard, shards have nearly equal bytes.

    ``size`` is the UTF-8 bytes of the text and one; a null text has none, and null texts are one group, empty ones another. ``slot`` numbers
    a shard's rows from 0 by ``doc_id`` (null last), then by group; rows that repeat an id and text stand side by side. Repeated rows count
    each. Other columns are left out; an empty table gives an empty result.
    """
    key = F.coalesce(F.unhex(F.sha2("text", 256)), F.lit(b""))  # equal digests are taken for equal texts
    sized = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(F.col("text")).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), key.alias("group_key")), "sized")
    groups = stage(sized.groupBy("group_key").agg(F.sum("size").alias("weight")), "groups")
    placed = stage(sized.join(group_shards(groups, shards), "group_key"), "sharded")
    return ranked(placed, ["shard"], [F.asc_nulls_last("doc_id"), F.asc("group_key")], "_rank").select("doc_id", "size", "text_crc32", "shard", (F.col("_rank") - 1).cast("long").alias("slot"))


def sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards by bytes. Nulls, ties, repeated rows and empty tables as ``shard_documents`` defines them."""
    placed = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
