"""Context-triggered piecewise hashing: fingerprints of whole texts that change only where the text does."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from garderobe.llm.shingles import mixed

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
CODES = np.frombuffer(LETTERS.encode(), np.uint8)
WINDOW = 7  # bytes that decide on a boundary
LEAST_BLOCK = 4
PIECES = 64  # the block size is the least one at which about so many pieces, or fewer, are expected
COMMON_RUN = 4  # unrelated signatures rarely share so many pieces in a row
PIVOTS_PER_PARTITION = 2
ROUND = np.uint64(0x9E3779B97F4A7C15)
TABLE = (mixed(np.arange(1, 257, dtype=np.uint64) * ROUND) >> np.uint64(32)).astype(np.uint32)  # a random number for each byte
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


# --- fingerprints -----------------------------------------------------------------------------------------------


def rolling(data: bytes) -> np.ndarray:
    """For each byte, a number that depends on it and the ``WINDOW`` - 1 bytes before it."""
    values = TABLE[np.frombuffer(data, np.uint8)]
    out = values.copy()
    for back in range(1, min(WINDOW, len(values))):
        turn = np.uint32(5 * back)
        out[back:] ^= (values << turn | values >> np.uint32(32) - turn)[:-back]
    out *= np.uint32(0x9E3779B1)
    return out >> np.uint32(8)


def block_size(n: int) -> int:
    size = LEAST_BLOCK
    while size * PIECES < n:
        size *= 2
    return size


def signature(data: bytes, ends: np.ndarray) -> str:
    """One letter for each piece that ends after a boundary, and one for what is left."""
    view, at, letters = memoryview(data), 0, []
    for end in [*(ends + 1).tolist(), len(data)]:
        if end > at:
            letters.append(zlib.crc32(view[at:end]) >> 26)
        at = end
    return CODES[letters].tobytes().decode() if letters else ""


def fingerprint(text: str) -> str:
    """``size:signature:signature at twice the size``. A boundary lies where the rolling number is a multiple of the size.

    While the signature has under half of ``PIECES`` letters and the size can be halved, it is.
    """
    data = text.encode()
    numbers = rolling(data)
    size = block_size(len(data))
    while True:
        ends = np.flatnonzero(numbers & np.uint32(size - 1) == 0)
        if size == LEAST_BLOCK or len(ends) + 1 >= PIECES // 2:
            return f"{size}:{signature(data, ends)}:{signature(data, ends[numbers[ends] & np.uint32(2 * size - 1) == 0])}"
        size //= 2


def distance(a: str, b: str) -> int:
    """Letters to delete and insert that turn one signature into the other, by the longest common subsequence in bits of a number."""
    where: dict[str, int] = {}
    for i, letter in enumerate(a):
        where[letter] = where.get(letter, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for letter in b:
        hit = row & where.get(letter, 0)
        row = (row + hit | row - hit) & full
    common = len(a) - row.bit_count()
    return len(a) + len(b) - 2 * common


def likeness_of(a: str, b: str) -> float:
    if a == b:
        return 1.0
    run = min(COMMON_RUN, max(1, min(len(a), len(b)) // 2))
    if not a or not b or {a[i : i + run] for i in range(len(a) - run + 1)}.isdisjoint(b[i : i + run] for i in range(len(b) - run + 1)):
        return 0.0
    return 1 - distance(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1: the greatest likeness of two signatures of equal block size; fingerprints whose sizes differ more than twofold have none."""
    if a == b:
        return 1.0
    (size_a, *sigs_a), (size_b, *sigs_b) = a.split(":"), b.split(":")
    of_a = {int(size_a): sigs_a[0], 2 * int(size_a): sigs_a[1]}
    of_b = {int(size_b): sigs_b[0], 2 * int(size_b): sigs_b[1]}
    return max((likeness_of(of_a[s], of_b[s]) for s in of_a.keys() & of_b.keys()), default=0.0)


def edited(text: str, after: str) -> str:
    """The last third of the code points replaced by the first as many of the next text, or by all of it."""
    third = len(text) // 3
    return text[: len(text) - third] + after[:third]


# --- neighbours in a global order -------------------------------------------------------------------------------


def neighbours(docs: DataFrame) -> DataFrame:
    """Documents dealt over ranges of descending ``doc_id`` so that each stands in one partition with its next one.

    Ranges are cut at approximate quantiles of the ids; the first document of a range is sent to the end of the range before it too
    (of the first range: to the last), so that only a few documents move twice. Columns: ``doc_id``, ``text``, ``part`` and ``tail``.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select("doc_id").filter("doc_id is not null")
    n = int(spark.conf.get("spark.sql.shuffle.partitions")) * PIVOTS_PER_PARTITION
    pivots = sorted(set(ids.stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n))) if n > 1 else []
    part: Column = F.when(F.col("doc_id").isNull(), len(pivots) + 1).otherwise(len(pivots) - place_among(F.col("doc_id"), [int(p) for p in pivots]))
    dealt = docs.withColumn("part", part.cast("int"))
    heads = dealt.groupBy("part").agg(F.max("doc_id").alias("head")).orderBy("part").collect()  # a row for each range
    before = {row.part: (heads[i - 1].part, row.head) for i, row in enumerate(heads)}
    if not before:
        return dealt.withColumn("tail", F.lit(False))
    to = F.create_map(*[F.lit(x) for part, (target, _) in before.items() for x in (part, target)])
    head_of = F.create_map(*[F.lit(x) for part, (_, head) in before.items() for x in (part, head)])
    is_head = F.col("doc_id").eqNullSafe(head_of[F.col("part")])
    places = F.when(is_head, F.array(F.struct(F.col("part"), F.lit(False).alias("tail")), F.struct(to[F.col("part")].alias("part"), F.lit(True).alias("tail")))).otherwise(F.array(F.struct(F.col("part"), F.lit(False).alias("tail"))))
    return dealt.withColumn("_at", F.explode(places)).select("doc_id", "text", "_at.part", "_at.tail")


def place_among(value: Column, pivots: list[int]) -> Column:
    """How many of the sorted pivots are at most ``value``, by halving."""
    if not pivots:
        return F.lit(0)
    middle = len(pivots) // 2
    return F.when(value >= pivots[middle], F.lit(middle + 1) + place_among(value, pivots[middle + 1 :])).otherwise(place_among(value, pivots[:middle]))


def fuzzy_hashes(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text, of its edited text, and their likeness to each other and to the next document's.

    The next document is the next one by descending ``doc_id``, then text; null ids come last; after the last comes the first, and a
    document that is alone is its own next. A null or empty text is the empty text, whose fingerprint is like no other. Rows that
    repeat an id follow each other. Other columns are left out; an empty table gives an empty result.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        print_of = lru_cache(4)(fingerprint)
        held = None  # the document that waits for its next one; of a range's tail only the first is one
        for batch in batches:
            out = []
            for doc, text, part, tail in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "tail")), strict=True):
                if held and held[2] == part:
                    out.append(hashed(held[0], held[1], text, print_of))
                held = None if tail else (doc, text, part)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(TYPES), TYPES, strict=True)], NAMES)

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = neighbours(docs).repartition(n, "part").sortWithinPartitions("part", "tail", F.col("doc_id").desc_nulls_last(), "text")
    return dealt.mapInArrow(rows, SCHEMA)


TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def hashed(doc: int | None, text: str, after: str, print_of=fingerprint) -> tuple:
    changed = edited(text, after)
    own, other = print_of(text), fingerprint(changed)
    return doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), own, other, likeness(own, other), likeness(own, print_of(after))


def fuzzy_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_hashes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
