"""Near duplicates by fast similarity sketches, banding and exact verification."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from garderobe.llm.components import connected
from garderobe.llm.shingles import FACTOR, mixed, shingle_set
from garderobe.session import stage

BANDS, ROWS = 33, 5  # a pair at 0.8 shares no band once in 500,000 times, at 0.85 once in 200 million
SIZE = BANDS * ROWS
PER_CENT = 80
BLOCK = 256  # distinct texts on either side of one comparison
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
LOW = np.uint64(0xFFFFFFFF)
SHIFT = np.uint64(32)
SEEDS = mixed(np.arange(1, 2 * SIZE + 1, dtype=np.uint64) * FACTOR)
SCHEMA = "doc_id long, text_key long, n_shingles long, set_key binary, bands array<long>"


# --- sketches ---------------------------------------------------------------------------------------------------


def sketch(items: np.ndarray) -> np.ndarray:
    """``SIZE`` coordinates of a non-empty set.

    In round i every item falls into one random bin with a random value; an earlier round beats a later one, and in a round the least
    value counts. When all bins are full, later rounds change nothing, so the loop ends. After ``SIZE`` rounds each bin that is still
    empty gets a round in which all items fall into it, so every coordinate is filled and each agrees with the similarity as its chance.
    """
    bins = np.full(SIZE, EMPTY)
    step = max(1, math.ceil(SIZE * (math.log(SIZE) + 2) / len(items)))
    for first in range(0, SIZE, step):
        rounds = np.arange(first, min(SIZE, first + step))
        h = mixed(items[None, :] + SEEDS[rounds][:, None])
        value = (rounds.astype(np.uint64)[:, None] << SHIFT) | (h & LOW)
        np.minimum.at(bins, ((h >> SHIFT) * np.uint64(SIZE) >> SHIFT).astype(np.intp).ravel(), value.ravel())
        if bins.max() != EMPTY:
            return bins
    for b in np.flatnonzero(bins == EMPTY).tolist():
        bins[b] = np.uint64(SIZE + b) << SHIFT | (mixed(items + SEEDS[SIZE + b]) & LOW).min()
    return bins


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """One number for each run of ``ROWS`` coordinates; runs of different bands never stand for each other."""
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in coordinates.reshape(BANDS, ROWS).T:
        keys = mixed(keys * FACTOR + column)
    return keys.view(np.int64)


def sketched(docs: DataFrame, words: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, bands = [], [], []
            for text in batch.column("text").to_pylist():
                items = shingle_set(text, words)
                n.append(len(items))
                keys.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None)
                bands.append(band_keys(sketch(items)) if len(items) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                                             ["doc_id", "text_key", "n_shingles", "set_key", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(rows, SCHEMA)


# --- verification -----------------------------------------------------------------------------------------------


def shared_items(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right."""
    if len(left) * len(right) <= 16:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left], np.int64).reshape(len(left), len(right))
    sets = left + right
    items, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    wanted = np.bincount(column[row < len(left)], minlength=len(items)).astype(bool) & np.bincount(column[row >= len(left)], minlength=len(items)).astype(bool)
    place = np.cumsum(wanted) - 1
    keep = wanted[column]
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(left), len(right)), np.float64)
    for first in range(0, int(wanted.sum()), 4096):
        at = slice(*np.searchsorted(column, (first, first + 4096)))
        has = np.zeros((len(sets), 4096), np.float32)
        has[row[at], column[at] - first] = 1
        total += has[: len(left)] @ has[len(left) :].T
    return np.rint(total).astype(np.int64)


def links(left: list[np.ndarray], right: list[np.ndarray], per_cent: int) -> np.ndarray:
    """Pairs (i, j) whose full sets reach the similarity."""
    both = shared_items(left, right)
    union = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :] - both
    return np.argwhere(100 * both >= per_cent * union)


def forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of the pairs that join two parts which no earlier pair has joined: they connect the same."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while above.setdefault(x, x) != x:
            above[x] = x = above[above[x]]
        return x

    out = []
    for a, b in pairs:
        x, y = top(a), top(b)
        if x != y:
            above[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def verified(cells: DataFrame, texts: DataFrame, words: int, per_cent: int) -> DataFrame:
    """(cell, rep, side) -> links (u, v). Side 0 is compared with side 1, side 2 with itself; a cell has ``BLOCK`` texts a side at most."""

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        sets = [shingle_set(t, words) for t in group["text"]]
        ids, side = group["rep"].tolist(), group["side"].to_numpy()
        left, right = np.flatnonzero(side != 1).tolist(), np.flatnonzero(side != 0).tolist()
        found = links([sets[i] for i in left], [sets[j] for j in right], per_cent).tolist()
        return pd.DataFrame(forest([(ids[left[i]], ids[right[j]]) for i, j in found if ids[left[i]] != ids[right[j]]]), columns=["u", "v"])

    return cells.join(texts, "rep").groupBy("cell").applyInPandas(compare, "u long, v long")


def blocks(n: str | Column) -> Column:
    """Blocks that so many texts are dealt over: about half full, so that chance does not overfill them."""
    return F.ceil((F.col(n) if isinstance(n, str) else n) / (BLOCK // 2)).cast("int")


def block_of(rep: str, n: Column) -> Column:
    return F.pmod(F.xxhash64(rep), n).cast("int")


def star_cells(members: DataFrame) -> DataFrame:
    """Each text of a bucket with the bucket's least one, in cells of bounded size."""
    edges = members.filter("rep <> low").groupBy("low", "rep").agg(F.max("n").alias("n")).withColumn("cell", F.xxhash64("low", "n", block_of("rep", blocks("n"))))
    least = edges.select("cell", F.col("low").alias("rep"), F.lit(0).alias("side")).distinct()
    return edges.select("cell", "rep", F.lit(1).alias("side")).unionByName(least)


def rest_cells(members: DataFrame, component: DataFrame) -> DataFrame | None:
    """What the stars leave open: in a bucket with several components, each text outside the largest with all of the bucket.

    None if nothing is open. Texts of the largest component are compared with the others only, so a large group with a few strays
    costs as many comparisons as it has rows.
    """
    named = component.withColumnRenamed("node", "rep")
    held = stage(members.filter("n > 2").join(named, "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("part")), "parts")
    parts = held.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("size"))
    open_ = parts.groupBy("bucket").agg(F.max(F.struct("size", "part")).alias("largest"), F.sum("size").alias("n"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    open_ = stage(open_.select("bucket", F.col("largest.part").alias("major"), blocks("largest.size").alias("n_major"), blocks(F.col("n") - F.col("largest.size")).alias("n_minor")), "open")
    if open_.isEmpty():
        return None
    rows = held.join(open_, "bucket").withColumn("is_major", F.col("part") == F.col("major")).withColumn("own", block_of("rep", F.when(F.col("is_major"), F.col("n_major")).otherwise(F.col("n_minor"))))
    minor_blocks = F.sequence(F.lit(0), F.col("n_minor") - 1)
    major = rows.filter("is_major").select("bucket", "rep", "own", F.explode(minor_blocks).alias("other")).select("rep", F.xxhash64("bucket", F.lit(0), "other", "own").alias("cell"), F.lit(1).alias("side"))
    with_major = rows.filter("not is_major").select("bucket", "rep", "own", F.explode(F.sequence(F.lit(0), F.col("n_major") - 1)).alias("other")).select("rep", F.xxhash64("bucket", F.lit(0), "own", "other").alias("cell"), F.lit(0).alias("side"))
    among = rows.filter("not is_major").select("bucket", "rep", "own", F.explode(minor_blocks).alias("other")).select("rep", F.xxhash64("bucket", F.lit(1), F.least("own", "other"), F.greatest("own", "other")).alias("cell"), F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"))
    return major.unionByName(with_major).unionByName(among)


def merged_buckets(in_bucket: DataFrame) -> DataFrame:
    """(rep, bucket) -> (bucket, n, low) of buckets with two or more texts, one of those with the same texts. A text that is listed twice counts once."""
    own = in_bucket.distinct().groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("low"), F.max("rep").alias("high"), F.bit_xor(F.xxhash64("rep")).alias("mark")).filter("low < high")
    return own.groupBy("n", "low", "high", "mark").agg(F.min("bucket").alias("bucket")).select("bucket", "n", "low")


# --- the operator -----------------------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, words: int = 5, per_cent: int = PER_CENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (``doc_id``, ``text``).

    Documents are linked if 100 x the size of the intersection of their shingle sets is at least ``per_cent`` x that of the union.
    Equal sets are one class, and only its least document is sketched into buckets. In a bucket every text is first compared with the
    least one; where that leaves several components in a bucket, the texts outside the largest are compared with the whole bucket in
    blocks. All comparisons are exact, on full sets; no bucket is capped.

    A text without words, a null text and a row with a null ``doc_id`` link with nothing (their component is their own id). Rows
    with the same ``doc_id`` are one document: what any of their texts links is linked. ``kept``: the document is the least of its
    component; a null ``doc_id`` is kept. An empty table gives an empty result; other columns are left out.
    """
    rows = stage(sketched(docs, words), "sketches")
    sets = rows.filter(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    classes = stage(sets.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "classes")
    banded = sets.join(classes.withColumnsRenamed({"set_key": "_key"}), (F.col("doc_id") == F.col("rep")) & (F.col("set_key") == F.col("_key")))
    in_bucket = banded.select("rep", "text_key", F.explode("bands").alias("bucket")).select("rep", "bucket")
    buckets = stage(merged_buckets(in_bucket), "buckets")
    members = stage(in_bucket.join(buckets, "bucket").distinct(), "members")
    needed = banded.select("rep", "text_key").distinct().join(members.select("rep").distinct(), "rep", "left_semi")
    keyed = docs.select(F.col("doc_id").cast("long").alias("rep"), F.xxhash64("text").alias("text_key"), "text")
    texts = stage(keyed.join(needed, ["rep", "text_key"], "left_semi").dropDuplicates(["rep", "text_key"]).drop("text_key"), "texts")
    found = stage(verified(star_cells(members), texts, words, per_cent), "links")
    several = sets.groupBy("doc_id").agg(F.min("set_key").alias("a"), F.max("set_key").alias("b")).filter("a <> b")
    if not several.isEmpty():
        own = sets.join(several.select("doc_id"), "doc_id", "left_semi").select("doc_id", "set_key").distinct().join(classes, "set_key")
        found = found.unionByName(own.select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
    component = connected(found)
    rest = rest_cells(members, component)
    if rest is not None:
        component = connected(found.unionByName(verified(rest, texts, words, per_cent)))
    named = stage(classes.join(component.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("set_key").alias("_key"), F.coalesce("component", "rep").alias("component")), "components")
    linked = rows.join(named, F.col("set_key") == F.col("_key"), "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return linked.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def minhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), per_cent=85)


def one_of_each(docs: DataFrame, words: int = 5, per_cent: int = PER_CENT) -> DataFrame:
    """The rows of ``docs`` of which no other is a near duplicate with a lesser id; of rows that repeat an id, the one with the least text.

    Rows with a null ``doc_id`` all stay.
    """
    gone = near_duplicates(docs, words, per_cent).filter("not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    repeats = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("doc_id")
    if repeats.isEmpty():
        return left
    first = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last())
    again = left.join(repeats, "doc_id", "left_semi").withColumn("_nth", F.row_number().over(first)).filter("_nth = 1")
    return left.join(repeats, "doc_id", "left_anti").select(docs.columns).unionByName(again.select(docs.columns))
